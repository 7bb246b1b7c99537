"""Spelling variant grouping: words one edit apart, by an even-partition pigeonhole join.

A word of length l is indexed under its two segments, cut in the middle. One inserted, deleted or replaced code point leaves one segment of the shorter
word (of either, if they are alike in length) untouched, at the start or at the end of the other word; so a word probes the segments of its own
length and of one less with its substrings at the start and, shifted by the difference in length, at the end. Words that meet are
verified, and pairs that met twice are counted once.

Segments that many words share (frequent prefixes and endings) are cut further by the same rule: what such words have besides the segment is again cut in
two, and one of these parts must be untouched, too. So a key never holds more than MOST_WORDS words unless all but two of its words' code points are
fixed, every pair of near words is still met, and no group's pairs are all made. A round of cutting is one job; words have half as much left after each.

A word's form is the near word that occurs most, if it occurs RATIO times as often; roots follow forms to the last, doubling their reach each
round.

Defined results: null, empty and wordless texts have no words; a null id counts as an empty one where typing errors are derived from ids; repeated
rows count each; ties go to the word that is smaller in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import discard, materialise, read
from tidemark.llm.importance import CAPITALS, CRC_TABLE, SMALL, crc_sql

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
LETTERS = r"A-Za-zÀ-ÿ"
#: A run loses a letter if this divides the hash of its document and itself.
ERROR_EVERY = 31
#: Words of a key beyond which it is cut further; the result doesn't depend on it.
MOST_WORDS = 64


def runs_with_errors(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """word: every run of at least `least` letters, A-Z lower-cased, after the derived deletions (it may then be shorter by one)."""
    run = F.explode(F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(f"[{LETTERS}]{{{least},}}"), 0)).alias("run")
    h = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = docs.select(key, run).select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % ERROR_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _parts(key: Column, rest: Column, longer: Column) -> Column:
    """Array of struct(key, rest): the two keys under which words meet that share `key` and have `rest` besides.

    The indexed words' rests have m code points (the longer ones' one more); their first m // 2 are one part, the others the second.
    """
    m = F.length(rest) - longer.cast("int")
    first = F.floor(m / 2).cast("int")
    part = lambda no, same, other: F.struct(F.xxhash64(key, F.lit(no), same).alias("key"), other.alias("rest"))
    ahead, behind = F.substring(rest, F.lit(1), first), F.substring(rest, first + 1, F.length(rest))
    before, end = F.substring(rest, F.lit(1), F.length(rest) - (m - first)), F.substring(rest, F.length(rest) - (m - first) + 1, m - first)
    return F.array(part(1, ahead, behind), part(2, end, before))


def keyed(words: DataFrame) -> DataFrame:
    """key, rest, longer, word, n: every word under the segments of its own length, and as `longer` one under those of one less."""
    each = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    length = F.length("word") - F.col("longer").cast("int")
    return each.select("word", "n", "longer", F.inline(_parts(F.xxhash64(length), F.col("word"), F.col("longer"))))


def cut_further(rows: DataFrame, most: int = MOST_WORDS) -> list[DataFrame]:
    """The rows in parts that are joined each for itself: keys with at most `most` words, and those of larger ones cut again and again."""
    done = []
    while True:
        sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.length("rest") - F.col("longer").cast("int")).alias("m")).where((F.col("size") > most) & (F.col("m") >= 2)).select("key"), "spelling-hot")
        if sizes.isEmpty():
            return [*done, rows]
        done.append(rows.join(sizes, "key", "left_anti"))
        hot = rows.join(sizes, "key", "left_semi")
        rows = materialise(hot.select("word", "n", "longer", F.inline(_parts(F.col("key"), F.col("rest"), F.col("longer")))), "spelling-cut")


def near_pairs(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """a, na, b, nb: all pairs of words one edit apart, once; a is the shorter, or of equal lengths the smaller.

    words: word, n; distinct words.
    """
    parts = cut_further(materialise(keyed(words), "spelling-keys"), most)
    met = None
    for rows in parts:
        a = rows.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        b = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
        pairs = a.join(b, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")
        met = pairs if met is None else met.unionByName(pairs)
    return met.distinct()


def nearest(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")))
    none = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("m"))
    best = F.min(F.when(F.col("m").isNotNull(), F.struct((-F.col("m")).alias("m"), "other"))).alias("best")
    found = both.unionByName(none).groupBy("word", "n").agg(F.count("m").alias("n_near"), best)
    enough = -F.col("best.m") >= ratio * F.col("n")
    return found.select("word", "n", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the last one reached by following forms.

    A form occurs RATIO times as often as its word, so chains are short and have no circles; each round doubles how far they are followed.
    """
    reached = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reached.join(ahead.select("root"), "root", "left_semi").isEmpty():
            return reached
        was, reached = reached, materialise(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        discard(was)


def group_variants(words: DataFrame, *, most: int = MOST_WORDS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word, by (word, n)."""
    words = materialise(words.select("word", "n"), "spelling-words")
    forms = materialise(nearest(words, near_pairs(words, most), ratio), "spelling-forms")
    linked = forms.join(roots(forms), "word", "left")
    return linked.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(counted(runs_with_errors(read(spark, sf_dir, "documents"))))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE = {
    "op13_spelling_variants": f"""with recursive {CRC_TABLE},
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
each_run as (select id, run, count(*) as k from runs group by id, run),
hashed as (select run, k, {crc_sql("(id || ':' || run)")} as h from each_run, crc where length(run) >= {LEAST_LENGTH}),
typed as (select case when h % {ERROR_EVERY} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
words as (select word, sum(k)::bigint as n from typed where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}),
less as (select word, n, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (select a.word as a, b.word as b from less a join less b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word != b.word
  union select a.word, b.word from words a join less b on a.word = b.rest
  union select b.word, a.word from words a join less b on a.word = b.rest),
near as (select a as word, count(*) as n_near, max(n) as top from pairs join words on words.word = b group by a),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, top, case when top >= {RATIO} * w.n then (select min(b) from pairs join words v on v.word = b where a = w.word and v.n = top) end as form
  from words w left join near using (word)),
walk as (select word, word as at from forms union all select walk.word, forms.form from walk join forms on forms.word = walk.at where forms.form is not null),
ends as (select walk.word, walk.at as root from walk join forms on forms.word = walk.at where forms.form is null)
select word, form, root, n, n_near::bigint as n_near, case when form is not null then top end as form_n from forms join ends using (word)"""
}
