"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule, so that a policy (a mask, versioned by name) and
its ablations are bitwise arithmetic on the ledger and never touch text again.  A ledger can be kept (``write_ledger``): any
later policy or ablation reads it in place of the texts.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, new_path, removed, stored, table, words

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Rules in the order of their bits: each fails a document when its condition holds.
RULES = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BASE = ("few_words", "repeat_words")
#: A policy names the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeat_words", "symbols", "duplicate_lines", "word_length", "capitals"),
    "base": BASE,
}


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(gram: Column, ranked: Column) -> Column:
    """Words covered by windows found twice or more.  ``ranked`` are the
    windows sorted by content; equal ones are neighbours there."""
    at = F.filter(
        ranked,
        lambda x, j: F.coalesce(F.get(ranked, j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["w"] == x["w"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(at, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")))["n"]
    return covered


def _measured(rows: DataFrame, carried: str) -> DataFrame:
    """The ledger of ``rows`` (carried, _text)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = rows.select(carried, "_text", words(F.col("_text")).alias("_w"), lines.alias("_l"))
    grams = F.when(
        F.size("_w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.array_join(F.slice("_w", i, WINDOW), " ")),
    ).otherwise(F.array().cast("array<string>"))
    measured = read.select(
        carried,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_upper"),
        grams.alias("_g"),
    )
    # Only texts in which a window comes back are sorted; all others have no repeat.
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    ranked = F.when(again, F.sort_array(F.transform("_g", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).otherwise(F.lit(None))
    full = measured.withColumn("_r", ranked).withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("_g"), F.col("_r")), F.lit(0)).cast("long"))
    bits = [F.when(F.expr(rule), F.lit(1 << b)).otherwise(F.lit(0)) for b, rule in enumerate(RULES.values())]
    # The row number adds nothing; it keeps Spark from moving a filter on the
    # ledger below it, where each mention of a measurement would be evaluated anew.
    nothing = F.when(F.monotonically_increasing_id() < 0, F.lit(1)).otherwise(F.lit(0))
    failures = (sum(bits[1:], bits[0]) + nothing).cast("long")
    return full.select(carried, *MEASURES).withColumn("failures", failures)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measurements as longs, failures long): one row per row.

    A null or empty text has no words, lines or symbols; repeated rows repeat;
    a null id stays null.  Other columns of ``docs`` are never read.
    """
    return _measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id")


def keep(docs: DataFrame, text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The rows that the policy accepts, with all their columns, whatever their names.
    Null and empty texts have no words; repeated rows and null ids are judged like
    any other; no rows give none.  The text is read once, so nothing is shuffled."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(text_col).alias("_text"))
    return apply_policy(_measured(rows, "_doc"), policy).where("kept").select(*[F.col("_doc")[c].alias(c) for c in names])


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """``rows`` of a ledger with ``base_failed`` and ``kept``."""
    hit = lambda m: F.col("failures").bitwiseAND(F.lit(m)) != 0
    return rows.withColumn("base_failed", hit(mask(BASE))).withColumn("kept", ~hit(mask(BASE)) & ~hit(mask(POLICIES[policy])))


def write_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ledger of ``docs`` with the names of its bits, in order, for ``read_ledger``."""
    ledger(docs, id_col, text_col).withColumn("rules", F.lit(",".join(RULES))).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger as written, its failure bits in today's order of rules.  Rules that
    it does not know are an error, as they would have to be evaluated."""
    rows = spark.read.parquet(path)
    old = rows.select("rules").distinct().limit(2).collect()
    names = old[0]["rules"].split(",") if old else list(RULES)
    if len(old) > 1 or not set(RULES) <= set(names):
        raise ValueError(f"{path}: not a ledger of the rules {list(RULES)}")
    bits = [F.when(F.col("failures").bitwiseAND(F.lit(1 << names.index(r))) != 0, F.lit(1 << b)).otherwise(F.lit(0)) for b, r in enumerate(RULES)]
    return rows.withColumn("failures", sum(bits[1:], bits[0]).cast("long")).drop("rules")


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only, kept_without): per rule of the policy how many
    rows fail it, fail no other rule, and would be kept without it.  Rows are
    counted by failure mask first (at most 2^rules groups).  No rows: no counts."""
    whole = mask(POLICIES[policy])
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    m, bit = F.col("m"), F.col("r.bit")
    return (
        counts.select("m", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(n(m.bitwiseAND(bit) != 0)("n_failed"), n(m == bit)("n_only"), n(m.bitwiseAND(F.bitwise_not(bit)) == 0)("kept_without"))
    )


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """Per policy and rule what the rule does, from a stored ledger of ``documents``."""
    path = new_path(spark, "ledger")
    write_ledger(table(spark, sf_dir, "documents"), path)
    out = None
    for policy in POLICIES:
        rows = ablations(read_ledger(spark, path), policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only", "kept_without")
        out = rows if out is None else out.unionByName(rows)
    out = stored(out)  # a row per policy and rule
    removed(spark, path)
    return out


def op2_quality(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, i + unnest(range(0, 5)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
       + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
       + 32 * (2 * n_upper > word_chars)::INT AS BIGINT) AS failures
  FROM m)
"""

OP2_SQL = (
    _LEDGER_SQL
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, failures = 0 AS kept, failures
FROM f
"""
)

ABLATIONS_SQL = (
    _LEDGER_SQL
    + ", "
    + f"""rules AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{r}', {1 << list(RULES).index(r)}, {mask(rules)})" for p, rules in POLICIES.items() for r in rules)}) v(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures & mask = bit) AS n_only,
       count(*) FILTER (failures & mask & ~bit = 0) AS kept_without
FROM f, rules GROUP BY policy, rule
"""
)
