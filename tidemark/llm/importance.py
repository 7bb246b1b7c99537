"""Target-distribution importance resampling: documents are drawn by how much likelier the target's n-grams make them than the corpus' own.

A document's features are its runs of 1 to 3 words, each hashed to one of BUCKETS buckets. A bucket's gain is the log ratio of its smoothed shares of
the target's and of the corpus' features, in thousandths; a document's weight is the sum of gains over its features. The draw is without
replacement: a score is the weight plus a Gumbel variate that the document's id fixes, and the SHARE of documents with the highest scores is drawn.

Higher-order functions make each document's array of buckets, which is written once; corpus counts are partial counts of buckets, so that only
BUCKETS totals a task are shuffled, and weights are sums over elements of one literal array of gains, without exploding or joining. Ranks come from a
range partitioning by score: places within sorted partitions, plus the counts of the partitions before.

Defined results: a null, empty or wordless text has no features and weight 0; a null id is hashed as an empty one and comes after all others in ties;
repeated rows are scored and drawn each for itself; an empty corpus gives no rows, and with an empty target all gains follow from the
smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import materialise, read

BUCKETS, LONGEST = 10_000, 3
#: Documents with fewer words are not drawn; PERCENT of the others are.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places in a partition are the low bits of monotonically_increasing_id.
PLACE_BITS = 33


def words(text: Column | str) -> Column:
    """Array of the words, A-Z lower-cased; null: none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(WORD), 0), F.array().cast("array<string>"))


def bucket_array(found: Column | str, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """Array of the buckets of all runs of 1 to `longest` words, by an array of words."""
    found = F.col(found) if isinstance(found, str) else found

    def runs(k: int) -> Column:
        def bucket(word: Column, i: Column) -> Column:
            run = F.concat_ws(" ", word, *(F.get(found, i + j) for j in range(1, k))) if k > 1 else word
            return (F.crc32(run.cast("binary")) % buckets).cast("int")

        return F.transform(F.slice(found, 1, F.greatest(F.size(found) - (k - 1), F.lit(0))) if k > 1 else found, bucket)

    return F.concat(*(runs(k) for k in range(1, longest + 1)))


def featured(rows: DataFrame, text: str, *keep: str | Column) -> DataFrame:
    """The columns to keep, n_words and buckets of every row."""
    found = rows.select(*keep, words(text).alias("_words"))
    return found.select(*found.columns[:-1], F.size("_words").alias("n_words"), bucket_array("_words").alias("buckets"))


def totals(features: DataFrame) -> dict[int, int]:
    """How many features of all rows each bucket holds: at most BUCKETS counts come to the driver."""
    return {r.bucket: r["count"] for r in features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, in thousandths, rounded down."""
    in_corpus, in_target = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda b: (target.get(b, 0) + 1.0) * in_corpus / ((corpus.get(b, 0) + 1.0) * in_target)
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def literal(numbers: list[int]) -> Column:
    """One array literal."""
    return F.expr(f"array({', '.join(f'{n}L' for n in numbers)})" if numbers else "cast(array() as array<bigint>)")


def weight(buckets: Column | str, gain: list[int]) -> Column:
    """The summed gains of an array of buckets."""
    table = literal(gain)
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))


def noise(key: Column | str, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, rounded down, that the key's hash fixes."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, eligible: Column, order: list[Column], percent: int = PERCENT) -> DataFrame:
    """The rows with their rank in the order, from 1, where they are among the first `percent` of the eligible; else null."""
    chance = scored.where(eligible)
    ranged = materialise(chance.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "importance-ranged")
    part = F.shiftrightunsigned("_at", PLACE_BITS)
    sizes = {r.part: r["count"] for r in ranged.groupBy(part.alias("part")).count().collect()}  # as many as there are partitions
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    rank = F.element_at(literal(before), part.cast("int") + 1) + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1 if total else F.lit(None).cast("long")
    ranked = ranged.withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop("_at")
    return scored.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score and rank (null: not drawn) of every row.

    docs, target: the corpus, and the texts whose distribution the draw shall have.
    """
    features = materialise(featured(docs, text, F.col(key).alias("id")), "importance-buckets")
    gain = gains(totals(features), totals(featured(target, target_text)))
    scored = features.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight("buckets", gain).alias("weight"))
    scored = materialise(scored.withColumn("score", F.col("weight") + noise("id", seed)), "importance-scores")
    return drawn(scored, F.col("n_words") >= least_words, [F.desc("score"), F.asc_nulls_last("id")], percent).withColumnRenamed("id", key)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: its table of 256 words as `crc`, and the register after a list of bytes.
CRC_TABLE = """crc as (select list(v order by i) as crc from (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) as r(i)))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a text's UTF-8 bytes, where `crc` is in scope."""
    byte = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


def _features_sql(name: str, table: str, key: str) -> str:
    return f"""{name}_words as (select row_number() over () as row, {key} as id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}') as w from {table}),
{name}_runs as (select row, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from {name}_words)"""


ORACLE = {
    "op11_importance_resampling": f"""with {CRC_TABLE},
{_features_sql("d", "documents", "doc_id")},
{_features_sql("t", "benchmark", "item_id")},
hashed as (select f, {crc_sql("f")} % {BUCKETS} as b from (select f from d_runs union select f from t_runs), crc),
d_sum as (select b, count(*) as s from d_runs join hashed using (f) group by b),
t_sum as (select b, count(*) as t from t_runs join hashed using (f) group by b),
size as (select (select coalesce(sum(s), 0) from d_sum) as big, (select coalesce(sum(t), 0) from t_sum) as small),
gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big + {BUCKETS})::double / ((s + 1)::double * (small + {BUCKETS})::double)))::bigint as g
  from d_sum left join t_sum using (b), size),
weights as (select row, count(*) as n, sum(g)::bigint as weight from d_runs join hashed using (f) join gain using (b) group by row),
scored as (select id as doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from d_words left join weights using (row)),
ranked as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id nulls last) as k, count(*) over (partition by n_words >= {LEAST_WORDS}) as n_all from scored)
select doc_id, n_features::bigint as n_features, weight, score::bigint as score, case when n_words >= {LEAST_WORDS} and k <= {PERCENT} * n_all // 100 then k end as rank from ranked"""
}
QUERIES = {"op11_importance_resampling": op11_importance_resampling}
