"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased and ASCII punctuation off their edges; those of nothing
else are none. Shingles are five words in turn (a shorter text or template is one shingle). A document holds a license if
in one of its windows at least ``threshold`` of the distinct shingles of one of the license's templates are found, with
all its marks and none of the phrases that show another license. ``license_catalog`` has the registered templates. An
``SPDX-License-Identifier:`` tag tells its licenses itself, known or not, with a containment of 1.

Templates of n distinct shingles belong to the class c, the next power of two. Windows of class c have 2c shingles
and begin at every c-th, so a run of up to c shingles lies whole in one window, and a window with 0.75 of a
template's shingles has a Jaccard similarity of at least 0.75 n / (2c + 0.25 n) >= 0.166 with it, or one half where
n = 1. With ``BANDS`` bands of one row each, such a window shares no band with a probability of at most
(1 - 0.166) ** 128 < 1e-10.

Shingles of no template can only hide a band, so signatures are of those of any template that a window holds, and of
windows that hold one; this loses nothing. It happens inside a document's row: no text is shuffled. The templates' bands are broadcast
where they are no more than ``BROADCAST_ROWS``.

Defined cases: null and empty texts hold no license; repeated rows and equal doc_ids are reported together, once for
each license; empty tables give empty results; other columns are ignored; a template without words fits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.llm.license_catalog import TEMPLATES
from bytewright.plans.columns import ascii_lower, pick
from bytewright.sources.tables import table

NAME = "op8_licenses"
SHINGLE, THRESHOLD, BANDS = 5, 0.75, 128
BROADCAST_ROWS = 200_000  # bands of templates; more are joined by a shuffle
_EDGE = r"!-/:-@\[-`{-~"
#: What parts words: white space with all punctuation around it.
_BETWEEN = rf"(?<![{_EDGE}])[{_EDGE}]*+[\x20\x09-\x0D][\x20\x09-\x0D{_EDGE}]*+"
_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*+(\(?[A-Za-z0-9.+-]++[()A-Za-z0-9.+ -]*)"


def template_shingles(text: str, size: int = SHINGLE) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split(_BETWEEN, f" {lower} ") if w]
    if not words:
        return []
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _among(value: Column, words: list[str]) -> Column:
    """``value.isin(words)``, with many words handed over at once."""
    jvm = SparkSession.active().sparkContext._jvm
    return Column(value._jc.isInCollection(jvm.java.util.Collections.list(jvm.java.util.StringTokenizer("\n".join(words), "\n"))))


def _windows(text: Column, every: list[str], classes: list[int], size: int) -> Column:
    """The windows of a text that hold a template's shingle: (class, held), held being the distinct ones of any template.
    Just where a shingle's first word begins one of a template it is put together and looked up."""
    firsts = sorted({x.split(" ")[0] for x in every})

    def of_words(words: Column) -> Column:
        n = F.greatest(F.size(words) - size + 1, F.lit(1))
        whole = lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " ")
        known = F.transform(words, lambda w, i: F.when(_among(w, firsts) & (i < n), _let(whole(i), lambda s: F.when(_among(s, every), s))))

        def of_known(known: Column) -> Column:
            hits = F.filter(F.transform(known, lambda s, i: F.when(s.isNotNull(), i)), lambda i: i.isNotNull())

            def of_class(hits: Column, c: int) -> Column:
                at = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.array(F.floor(h / c).cast("int"), F.greatest(F.floor(h / c).cast("int") - 1, F.lit(0))))))
                return F.transform(at, lambda k: F.struct(F.lit(c).alias("class"), F.array_distinct(F.array_compact(F.slice(known, k * c + 1, F.lit(2 * c)))).alias("held")))

            return _let(hits, lambda h: F.concat(*(of_class(h, c) for c in classes)))

        return _let(known, of_known)

    return _let(F.filter(F.split(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), _BETWEEN), lambda w: w != ""), of_words)


def spdx(text: Column) -> Column:
    """The licenses that SPDX tags name, without ``-only``, ``-or-later`` and ``+``; exceptions are none."""
    tags = F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1))

    def of_tag(tag: Column) -> Column:
        # one license, then any number of operators with their licenses; other words are no part of the tag
        tag = F.regexp_extract(F.regexp_replace(tag, "[()]", " "), r"^ *[^ ]+(?: +(?:AND|OR|WITH|and|or|with) +[^ ]+)*", 0)
        names = F.split(F.trim(F.regexp_replace(tag, " +(?:WITH|with) +[^ ]+", "")), " +(?:AND|OR|and|or) +")
        return F.transform(names, lambda x: F.regexp_replace(F.regexp_replace(x, r"\.+$", ""), r"(?:-only|-or-later|\+)$", ""))

    return F.filter(F.array_distinct(F.flatten(F.transform(tags, of_tag))), lambda x: x != "")


def scan(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """``docs`` has doc_id and text; ``templates`` are (name, text) or (name, text, marks, unless). A row for each document
    and license: doc_id, license, containment (the most of any window) and n_windows (those that reach the threshold,
    for each template)."""
    spark = docs.sparkSession
    known = [(name, s, *((list(x) for x in more) if more else ([], []))) for name, text, *more in templates if (s := template_shingles(text, size))]
    every = sorted({x for _, s, *_ in known for x in s})
    classes = sorted({1 << (len(s) - 1).bit_length() for _, s, *_ in known})
    if not every:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long")
    # explode_outer: of the other, Spark would infer a filter that computes all windows twice
    rows = docs.select("doc_id", F.explode_outer(_windows(F.col("text"), every, classes, size)).alias("w")).where("w is not null").select("doc_id", "w.*")
    signature = lambda held: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(held, lambda s: F.xxhash64(s, b))).alias("least")))
    sets = spark.createDataFrame([(n, name, 1 << (len(s) - 1).bit_length(), s, marks, unless) for n, (name, s, marks, unless) in enumerate(known)], "number int, license string, class int, template array<string>, marks array<string>, unless array<string>")
    keys = sets.select("number", "class", F.explode(signature(F.col("template"))).alias("key"))
    if len(known) * bands <= BROADCAST_ROWS:
        keys, sets = F.broadcast(keys), F.broadcast(sets)
    pairs = rows.select("doc_id", "class", "held", F.explode(signature(F.col("held"))).alias("key")).join(keys, ["class", "key"])
    pairs = pairs.groupBy("doc_id", "number", "held").agg(F.count(F.lit(1)).alias("shared")).join(sets, "number")
    common = F.array_intersect("template", "held")
    has = lambda where, phrase: F.exists(where, lambda s: F.instr(F.concat(F.lit(" "), s, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0)
    fits = pairs.withColumn("containment", F.size(common) / F.size("template")).where(F.col("containment") >= threshold)
    fits = fits.where(F.forall("marks", lambda m: has(common, m)) & ~F.exists("unless", lambda m: has(F.col("held"), m)))
    found = fits.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of ``TEMPLATES``, and of SPDX tags, in every document: doc_id, license, containment."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    tagged = docs.select("doc_id", F.explode(spdx(F.col("text"))).alias("license"), F.lit(1.0).alias("containment"))
    found = scan(docs).select("doc_id", "license", "containment").unionByName(tagged)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, len(w) - 4 AS n, unnest(range(0, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5
), g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM s),
t(license, txt) AS (
  VALUES ('Apache-2.0', 'licensed under the apache license, version 2.0.'), ('CC-BY-NC-4.0', 'licensed under cc by-nc 4.0.'),
         ('GPL-3.0', 'this work is licensed under the gnu general public license, version 3.'), ('MIT', 'released under the mit license.')
), x AS (SELECT license, string_split(txt, ' ') AS w FROM t),
y AS (SELECT license, len(w) - 4 AS n, unnest(range(0, len(w) - 4)) AS j, w FROM x),
z AS (SELECT license, n, CASE WHEN n = 1 THEN 1 WHEN n <= 2 THEN 2 WHEN n <= 4 THEN 4 ELSE 8 END AS c, array_to_string(w[j + 1 : j + 5], ' ') AS g FROM y),
m AS (SELECT doc_id, license, n, c, i, g FROM g JOIN z USING (g)),
k AS (
  SELECT doc_id, license, n, i // c AS win, g FROM m UNION ALL SELECT doc_id, license, n, i // c - 1, g FROM m WHERE i // c > 0
), q AS (SELECT doc_id, license, win, count(DISTINCT g) / n::DOUBLE AS containment FROM k GROUP BY doc_id, license, win, n)
SELECT doc_id, license, max(containment) AS containment FROM q WHERE containment >= 0.75 GROUP BY doc_id, license
"""
