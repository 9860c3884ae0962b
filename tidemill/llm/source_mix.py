"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Leaves are (domain, language, source). A leaf can give its tokens ``max_epochs`` times. Budgets go down the tree: a
node's children share its budget by weight, a child that can't hold its share gives the rest to its siblings (water
filling), and only what no sibling can hold goes to the parent's siblings, since a node is never given more than its
subtree holds. Shares are whole tokens and add up exactly.

A leaf takes whole epochs, and of one more epoch the token-prefix in the order of a seeded hash of (seed, epoch, id).
The prefix ends at a hash that is found by radix: tokens are summed by leaf and 8 bits of the hash (partial sums, then
at most 256 rows a leaf), the bucket in which the prefix ends is divided again, and only what is left of it is sorted.
A document's copies follow from its leaf's plan and its hash, so documents are never shuffled, and no leaf, however
large, is gathered.

Defined results: null language or source is the node ``unknown``; null text has no tokens; a null id counts as the
empty string; rows that share an id share their hash, so they are taken together; a leaf without tokens takes none; an
empty table gives no rows; very long texts are counted by Spark like any other; extra columns pass through, whatever
their names, but for those of :data:`OUT` in ``copies_of``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_text, small, written

LEVELS = ("domain", "language", "origin")
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """``weights``: positive whole numbers by path (``web``, ``web/en``, ``web/en/src0``); a name in place of a path
    (``*/en``, ``*/*/src0``) holds below every parent; others weigh 1. ``share``: the budget in proportion to all
    tokens. ``max_epochs``: how often a leaf may be used."""

    weights: dict[str, int] = field(default_factory=dict)
    share: float = 1.0
    max_epochs: int = 1
    seed: int = 1

    def __post_init__(self):
        if any(int(w) != w or not 0 < w <= 1_000_000 for w in self.weights.values()) or self.max_epochs < 1 or self.share < 0:
            raise ValueError("weights are whole numbers from 1 to 1000000, max_epochs at least 1, share at least 0")


def _weight(mix: Mixture, level: int) -> Column:
    """The weight of a node of ``level`` (0: domain), from its own path or a pattern."""
    path = F.concat_ws("/", *LEVELS[: level + 1])
    exact = {k: w for k, w in mix.weights.items() if k.count("/") == level and not k.startswith("*/")}
    anywhere = {k.rpartition("/")[2]: w for k, w in mix.weights.items() if k.count("/") == level and k.startswith("*/")}
    found = []
    for key, table in ((path, exact), (F.col(LEVELS[level]), anywhere)):
        if table:
            found.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key))
    return F.coalesce(*found, F.lit(1)).cast("decimal(10,0)")


def _shared(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes`` of one level (its path, ``cap``, the parent's ``budget``) with ``budget`` of their own."""
    parent = [F.col(c) for c in LEVELS[:level]] or [F.lit(0)]
    whole = Window.partitionBy(*parent)
    upto = whole.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")), F.col(LEVELS[level])).rowsBetween(Window.unboundedPreceding, 0)
    x = nodes.withColumns({"cap_upto": F.sum("cap").over(upto), "weight_upto": F.sum("weight").over(upto), "weight_all": F.sum("weight").over(whole)})
    # with a share per weight of cap / weight, the nodes up to this one are full, and the others take by weight
    full = F.col("cap_upto") * F.col("weight") + F.col("cap") * (F.col("weight_all") - F.col("weight_upto")) <= F.col("budget") * F.col("weight")
    x = x.withColumn("full", full)
    open_weight = F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight")).cast("decimal(10,0)")
    x = x.withColumns(
        {
            "rest": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0).cast("decimal(20,0)"))).over(whole),
            "open_all": F.sum(open_weight).over(whole),
            "open_upto": F.sum(open_weight).over(upto),
        }
    )
    part = F.expr("(rest * open_upto) div open_all - (rest * (open_upto - weight)) div open_all")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("decimal(20,0)")).select(*LEVELS[: level + 1], "cap", "budget")


def budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """``leaves`` (path, ``tokens``) with ``budget``. Small tables: a row for each node."""
    sized = leaves.withColumn("cap", (F.col("tokens") * mix.max_epochs).cast("decimal(20,0)"))
    above = None
    for level in range(len(LEVELS)):
        path = list(LEVELS[: level + 1])
        nodes = sized.groupBy(*path).agg(F.sum("cap").cast("decimal(20,0)").alias("cap"), F.sum("tokens").alias("own"))
        if above is None:
            whole = F.sum("own").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.floor(whole * F.lit(mix.share)).cast("decimal(20,0)"))
        else:
            nodes = nodes.join(small(above.select(*path[:-1], "budget")), path[:-1])
        above = _shared(nodes.withColumn("weight", _weight(mix, level)), level)
    return leaves.join(small(above.select(*LEVELS, F.col("budget").cast("long"))), list(LEVELS))


def _hash(mix: Mixture) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.col("key")))


def _cut(rows: DataFrame, start: int) -> DataFrame:
    """Of each leaf: the bucket (two hex digits of ``h`` from ``start``) in which ``need`` tokens are reached, and how
    many are needed from it."""
    sums = rows.groupBy(*LEVELS, F.substring("h", start, 2).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.max("need").alias("need"))
    w = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return written(at.select(*LEVELS, "bucket", (F.col("need") - F.col("upto") + F.col("n")).alias("need")), "mix-cut")


def plan(narrow: DataFrame, mix: Mixture, digits: int = 4) -> DataFrame:
    """A row for each leaf of ``narrow`` (path, ``key``, ``n_tokens``): ``epochs``, and the hash ``last`` up to which
    one more epoch is taken, ``last_take`` tokens of the document that has it. ``digits``: of the hash, by which the
    prefix's end is searched before the rest is sorted."""
    leaves = written(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    got = budgets(leaves, mix)
    epochs = F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END").cast("int")
    got = written(got.withColumn("epochs", epochs).withColumn("need", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-epochs")
    rows = narrow.where("n_tokens > 0").join(small(got.where("need > 0").select(*LEVELS, "epochs", "need")), list(LEVELS)).withColumn("h", _hash(mix))
    for start in range(1, digits, 2):
        cut = _cut(rows, start)
        rows = rows.drop("need").join(small(cut), list(LEVELS)).where(F.substring("h", start, 2) == F.col("bucket")).drop("bucket")
    tied = rows.groupBy(*LEVELS, "h").agg(F.sum("n_tokens").alias("n"), F.max("need").alias("need"))
    w = Window.partitionBy(*LEVELS).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    ended = tied.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    ended = ended.select(*LEVELS, F.col("h").alias("last"), (F.col("need") - F.col("upto") + F.col("n")).alias("last_take"))
    return written(got.join(small(ended), list(LEVELS), "left").select(*LEVELS, "tokens", "budget", "epochs", "last", "last_take"), "mix-plan")


def _described(df: DataFrame, domain: Column, id_col: str, text: str, lang: str, source: str) -> dict[str, Column]:
    return {
        "domain": F.coalesce(domain, F.lit("unknown")),
        "language": F.coalesce(F.col(lang), F.lit("unknown")),
        "origin": F.coalesce(F.col(source), F.lit("unknown")),
        "key": id_text(id_col),
        "n_tokens": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
    }


OUT = ("domain", "language", "origin", "n_tokens", "copies", "taken")


def copies_of(df: DataFrame, mix: Mixture, domain: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` that are taken, without the columns of ``drop``, with their path, ``n_tokens``, ``copies`` and
    ``taken`` tokens in all. Texts are read once if ``drop`` has them, else twice."""
    new = [v.alias(k) for k, v in _described(df, domain, id_col, text, lang, source).items()]
    held = df.select(F.struct(*[c for c in df.columns if c not in OUT and c not in drop]).alias("_row"), *new)
    narrow = written(held if text in drop else held.drop("_row"), "mix-narrow")
    copies, more, x = _decided(plan(narrow.drop("_row"), mix), narrow if text in drop else held, mix, F.col("n_tokens") > 0)
    last = F.when(_hash(mix) == F.col("last"), F.least(F.col("n_tokens"), F.col("last_take"))).otherwise(F.col("n_tokens"))
    taken = F.col("epochs") * F.col("n_tokens") + F.when(more, last).otherwise(F.lit(0))
    return x.withColumns({"copies": copies, "taken": taken}).where("copies > 0").select("_row.*", *OUT)


def _decided(leaf_plan: DataFrame, rows: DataFrame, mix: Mixture, some: Column) -> tuple[Column, Column, DataFrame]:
    """(how often a row is taken, whether in the last epoch, ``rows`` with their leaf's plan). ``some``: it has tokens."""
    x = rows.join(small(leaf_plan.drop("tokens", "budget")), list(LEVELS))
    more = F.coalesce(_hash(mix) <= F.col("last"), F.lit(False)) & some
    return F.col("epochs") + more.cast("int"), more, x


def mixed(df: DataFrame, mix: Mixture, domain: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df``, its columns as they were, with each row as often as it is taken; whole documents."""
    new = _described(df, domain, id_col, text, lang, source)
    narrow = written(df.select(*[v.alias(k) for k, v in new.items()]), "mix-narrow")
    some = F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("some")  # ends at the first word
    rows = df.select(F.struct(*df.columns).alias("_row"), some, *[v.alias(k) for k, v in new.items() if k != "n_tokens"])
    copies, _, x = _decided(plan(narrow, mix), rows, mix, F.col("some"))
    got = x.withColumn("copies", copies).where("copies > 0")
    if mix.max_epochs > 1:
        got = got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return got.select("_row.*")


#: The mixture of the registered query: domains by the number in a source's name.
DOMAINS = ("web", "news", "books", "code")
MIX = Mixture(
    weights={"web": 4, "news": 2, "books": 3, "code": 1, "*/en": 5, "*/de": 2, "*/fr": 2, "*/es": 1, "*/*/src0": 3},
    share=1.0,
    max_epochs=4,
    seed=20240607,
)


def domain_of(source: str = "source") -> Column:
    number = F.try_to_number(F.right(F.regexp_extract(F.col(source), r"([0-9]+)$", 1), F.lit(6)), F.lit("999999")).cast("int")
    out = F.lit(None).cast("string")
    for i, name in enumerate(DOMAINS):
        out = F.when(number % len(DOMAINS) == i, name).otherwise(out)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return copies_of(docs, MIX, domain_of(), drop=("text",)).select("doc_id", "domain", "language", F.col("origin").alias("source"), "n_tokens", "copies", "taken")


def sql(mix: Mixture = MIX, documents: str = "documents") -> str:
    """The registered query in DuckDB SQL: the same tree, and a running sum in place of the radix search."""
    names = "CASE CAST(right(regexp_extract(source, '([0-9]+)$', 1), 6) AS INTEGER) % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DOMAINS)) + " END"
    names = f"CASE WHEN regexp_matches(source, '[0-9]$') THEN {names} END"
    parts = [
        f"""d AS (SELECT doc_id, coalesce({names}, 'unknown') AS domain, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
        coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM {documents})""",
        "leaf AS (SELECT domain, language, origin, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL)",
        f"b0 AS (SELECT floor(coalesce(sum(tokens), 0) * {mix.share})::HUGEINT AS budget FROM leaf)",
    ]
    for level in range(3):
        path, parent = ", ".join(LEVELS[: level + 1]), ", ".join(LEVELS[:level]) or "0"
        cases = " ".join(
            f"WHEN {LEVELS[level] if k.startswith('*/') else ' || chr(47) || '.join(LEVELS[: level + 1])} = '{k.rpartition('/')[2] if k.startswith('*/') else k}' THEN {w}"
            for k, w in sorted(mix.weights.items(), key=lambda kw: kw[0].startswith("*/"))
            if k.count("/") == level
        )
        weight = f"CASE {cases} ELSE 1 END::HUGEINT" if cases else "1::HUGEINT"
        join = f"JOIN b{level} USING ({', '.join(LEVELS[:level])})" if level else "CROSS JOIN b0"
        upto = f"OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / weight::DOUBLE, {LEVELS[level]} ROWS UNBOUNDED PRECEDING)"
        parts += [
            f"n{level} AS (SELECT *, {weight} AS weight FROM (SELECT {path}, sum(tokens * {mix.max_epochs})::HUGEINT AS cap FROM leaf GROUP BY ALL) {join})",
            f"u{level} AS (SELECT *, sum(cap) {upto} AS cap_upto, sum(weight) {upto} AS weight_upto, sum(weight) OVER (PARTITION BY {parent}) AS weight_all FROM n{level})",
            f"f{level} AS (SELECT *, cap_upto * weight + cap * (weight_all - weight_upto) <= budget * weight AS fl FROM u{level})",
            f"o{level} AS (SELECT *, budget - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS rest, sum(CASE WHEN fl THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_all, sum(CASE WHEN fl THEN 0 ELSE weight END) {upto} AS open_upto FROM f{level})",
            f"b{level + 1} AS (SELECT {path}, CASE WHEN fl THEN cap ELSE (rest * open_upto) // open_all - (rest * (open_upto - weight)) // open_all END AS budget FROM o{level})",
        ]
    parts += [
        "p AS (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs FROM leaf JOIN b3 USING (domain, language, origin))",
        f"h AS (SELECT d.*, epochs::INTEGER AS epochs, budget - epochs * tokens AS need, md5('{mix.seed}:' || epochs::INTEGER || ':' || key) AS h FROM d JOIN p USING (domain, language, origin))",
        "s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY h RANGE UNBOUNDED PRECEDING) - sum(n_tokens) OVER (PARTITION BY domain, language, origin, h) AS bef FROM h)",
        "r AS (SELECT *, n_tokens > 0 AND bef < need AS more FROM s)",
    ]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, language, origin AS source, n_tokens, (epochs + more::INTEGER)::INTEGER AS copies, "
        "(epochs * n_tokens + CASE WHEN more THEN least(n_tokens, need - bef) ELSE 0 END)::BIGINT AS taken FROM r WHERE epochs + more::INTEGER > 0"
    )
