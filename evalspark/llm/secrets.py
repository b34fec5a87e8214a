"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger keeps which (blob, rule
version) pairs have been scanned and what was found; a scan reads only blobs with an unseen pair, appends
to the ledger, and joins the findings back to all paths. Null text counts as empty; repeated rows, null paths
and other columns are kept out of the ledger's way, since only contents are scanned. An empty table gives no
rows. Scanning a pair again after a failed append is harmless: readers merge the pairs of a blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import table
from evalspark.scaling import shared_folder


@dataclass(frozen=True)
class Rule:
    """A pattern; of its leftmost matches those count whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


# Fixed values of the contract. A run of too few characters cannot hide a longer one in `access` and `hex`,
# so their least length stands in the pattern; `assign` is matched freely and then filtered.
BASE = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of a rule's matches: the lengths of what lies between and of the matches, added up."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tests = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    both = F.zip_with(sizes, tests, lambda size, test: F.struct(size.alias("size"), test.alias("test")))
    steps = F.zip_with(F.slice(between, 1, F.size(sizes)), both, lambda gap, b: F.struct(gap.alias("gap"), b.alias("b")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(state, step):
        start = state["at"] + step["gap"]
        end = start + step["b"]["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        kept = F.when(step["b"]["test"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, empty, add)["out"]).otherwise(empty["out"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, scanned, spans) with one row per blob; spans carry `rule`, that is kind and version."""
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
    )


LEDGER = "blob string, scanned array<string>, spans array<struct<rule:string,start:int,end:int>>"


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, known: bool = True, copies: bool = True) -> None:
    """Scan the blobs of `versions` (column text) for the rule versions that the ledger at `path` has not seen of them.

    With `known` false the ledger is new and not read. With `copies` false the versions are expected to differ: texts are
    scanned where they are, without a shuffle; a blob that occurs again is scanned again, which readers of the ledger merge.
    """
    spark = versions.sparkSession
    text = F.coalesce("text", F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if copies:
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen = F.array().cast("array<string>")
    if known:
        blobs = blobs.join(read_ledger(spark, path).select("blob", F.col("scanned").alias("_seen")), "blob", "left")
        seen = F.coalesce("_seen", seen)
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    todo = blobs.withColumn("scanned", F.array_except(wanted, seen)).where(F.size("scanned") > 0)
    nothing = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(F.array_contains("scanned", rule.key), _spans(F.col("text"), rule, i)).otherwise(nothing)
        for i, rule in enumerate(rules)
    ]
    names = F.array(*[F.lit(rule.key) for rule in rules])
    rows = todo.select("blob", "scanned", F.concat(*found).alias("found")).select(
        "blob",
        "scanned",
        F.transform(
            "found", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("rule"), s["start"].alias("start"), s["end"].alias("end"))
        ).alias("spans"),
    )
    rows.write.mode("append").parquet(path)


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of `versions` with `__spans`: array of (start, kind as index of the rules, end), in order."""
    spark = versions.sparkSession
    keys = F.array(*[F.lit(rule.key) for rule in rules])
    current = F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))
    hits = read_ledger(spark, path).select("blob", current.alias("s")).where(F.size("s") > 0)
    hits = hits.select(
        F.col("blob").alias("__blob"),
        F.array_sort(
            F.transform(
                "s",
                lambda s: F.struct(
                    s["start"].alias("start"), (F.array_position(keys, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")
                ),
            )
        ).alias("__spans"),
    )
    keyed = versions.withColumn("__blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(hits, "__blob", "left").drop("__blob").withColumn("__spans", F.coalesce("__spans", F.array().cast(f"array<{SPAN}>")))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span replaced by `mark`; overlapping spans by one. n_chars follows the new text."""
    # Each step holds the text so far and the place up to which the old text is used.
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, s):
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        text = F.when(s["end"] <= state["at"], state["out"]).otherwise(
            F.when((s["start"] < state["at"]) & (state["at"] > 0), state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mark)))
        )
        return F.struct(text.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    def rebuilt(spans):
        end = F.aggregate(spans, first, step)
        return F.concat(end["out"], F.substring(F.col("text"), end["at"] + 1, F.length("text")))

    found = findings(docs, path, rules)
    text = F.when(F.size("__spans") > 0, rebuilt(F.col("__spans"))).otherwise(F.col("text"))
    found = found.withColumn("__new", text)
    out = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size("__spans") > 0, F.length("__new").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return found.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, through a new ledger."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = shared_folder(spark, "llm-ledger")
    update_ledger(docs, path, known=False)
    found = findings(docs, path)
    base = F.filter("__spans", lambda s: s["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{BASE[i].kind}")

    counts = [count(i) for i in range(len(BASE))]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("__spans"), RULES).alias("spans")
    )


def _sql() -> str:
    def found(i: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""SELECT r, {i} AS kind_order, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i:
            {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
              'l': length(m[i]), 'g': length(g[i])}})) AS x
          FROM (SELECT r, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}', 0) AS m,
            regexp_extract_all(text, '{p}', {rule.group}) AS g FROM d WHERE regexp_matches(text, '{p}'))
          WHERE len(m) > 0"""

    parts = " UNION ALL ".join(
        f"SELECT r, kind_order, kind, x.s::BIGINT AS s, (x.s + x.l)::BIGINT AS e FROM ({found(i, r)}) WHERE x.g >= {r.least}" for i, r in enumerate(RULES)
    )
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({parts}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  {listed} FILTER (kind_order < {len(BASE)}) AS base, {listed} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
