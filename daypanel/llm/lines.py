"""Line deduplication by content-defined chunks of lines, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.text import named
from daypanel.sources.tables import written

# Parameters of the chunking: a boundary after one line in SHARE, by a rolling hash over two line hashes.
SHARE = 3
#: A line of more words is a chunk by itself; such a line may be a passage that stands on one line.
LONG_WORDS = 50
#: Words that a chunk of several lines has at least if it may go.
LEAST_WORDS = 10
MODULUS = 1_000_003
NO_KEY = -(1 << 63)


def line_hash(line: Column) -> Column:
    """60 bits of a line."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def words_in(line: Column) -> Column:
    """Blanks and one more."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def with_chunks(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `lines` and `chunks`, an array of (start, size, words) that covers the lines in order.

    After a line a chunk ends if the rolling hash of its last two lines says so,
    or if that line or the next is long; an insertion above moves no boundary
    more than a line away from it.
    """
    lined = docs.withColumn("lines", F.split(F.col(text), "\n"))
    facts = F.transform("lines", lambda x: F.struct((line_hash(x) % MODULUS).alias("h"), words_in(x).alias("words")))
    known = lined.withColumn("facts", facts)
    long = lambda i: F.get("facts", i)["words"] > LONG_WORDS
    rolled = lambda i: (F.coalesce(F.get("facts", i - 1)["h"], F.lit(0)) * 31 + F.get("facts", i)["h"]) % MODULUS
    starts = F.filter(
        F.sequence(F.lit(0), F.size("facts") - 1),
        lambda i: (i == 0) | (rolled(i - 1) % SHARE == 0) | long(i - 1) | long(i),
    )
    begun = known.withColumn("starts", starts)

    def chunk(s: Column, k: Column) -> Column:
        size = F.coalesce(F.get("starts", k + 1), F.size("facts")) - s
        words = F.aggregate(F.slice("facts", s + 1, size), F.lit(0), lambda n, f: n + f["words"])
        return F.struct(s.alias("start"), size.alias("size"), words.alias("words"))

    return begun.withColumn("chunks", F.transform("starts", chunk)).drop("facts", "starts")


def _text_of(chunk: Column) -> Column:
    return F.array_join(F.slice("lines", chunk["start"] + 1, chunk["size"]), "\n")


def _removable(chunk: Column) -> Column:
    return (chunk["size"] >= 2) & (chunk["words"] >= LEAST_WORDS) | (chunk["words"] > LONG_WORDS)


def drop_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated chunks of lines taken out of `text`, and `lines_total`, `lines_removed`.

    Every text is cut into chunks of lines where its content says so
    (`with_chunks`). Chunks of several lines and `LEAST_WORDS` words, and lines
    of more than `LONG_WORDS` words, are compared by their bytes over all
    documents; of equal ones only the first stays, that of the smallest key and
    in it the first. What remains of a text is its other lines in order; a text
    without such chunks stays as it is to the byte.

    The bytes of chunks meet in a grouping with map-side combine, so a passage
    in a third of all documents moves once per task. A null text stays null
    with 0 lines, an empty one has one empty line, a null key is smaller than
    any other. Rows that repeat key and text are one document and get equal
    results. An empty table gives no rows. All columns stay, whatever their
    names, but for `lines_total` and `lines_removed`, which are replaced.
    """
    own = docs.select(
        F.coalesce(named(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(named(text)).alias("print"), named(text).alias("text")
    )
    found = with_chunks(own, "text").select("key", "print", "lines", F.explode(F.filter("chunks", _removable)).alias("chunk"))
    # Documents in order of their keys, texts and lines in order inside them: different rows are never one place.
    place = F.struct(F.col("key"), F.col("print"), F.col("chunk.start").alias("start"))
    placed = found.select("key", "print", place.alias("place"), "chunk.start", "chunk.size", _text_of(F.col("chunk")).alias("bytes"))
    repeated = (
        placed.groupBy("bytes")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .filter("first < last")
        .select(F.sha2("bytes", 256).alias("id"), "first")
    )
    later = placed.select("key", "print", "place", "start", "size", F.sha2("bytes", 256).alias("id")).join(repeated, "id")
    gone = (
        later.filter("place <> first")
        .groupBy(F.col("key").alias("gone_key"), F.col("print").alias("gone_print"))
        .agg(F.collect_set(F.struct("start", "size")).alias("gone"))
    )
    return _without(docs, gone, key, text)


def _merged(units: Column) -> Column:
    """The ranges (start, end) of lines that units (start, size) cover, in order and apart."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    one = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))

    def step(at: Column, u: Column) -> Column:
        end = u["start"] + u["size"]
        return F.when(
            u["start"] <= at["end"],
            F.struct(at["done"].alias("done"), at["start"].alias("start"), F.greatest(at["end"], end).alias("end")),
        ).otherwise(
            F.struct(
                F.when(at["end"] < 0, at["done"]).otherwise(F.concat(at["done"], F.array(one(at["start"], at["end"])))).alias("done"),
                u["start"].alias("start"),
                end.alias("end"),
            )
        )

    first = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.aggregate(F.array_sort(units), first, step, lambda at: F.concat(at["done"], F.array(one(at["start"], at["end"]))))


def _without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """`docs` without the lines of `gone`, (gone_key, gone_print, gone: array of (start, size)), with the two counts."""
    kept = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    row = F.struct(*[named(c) for c in kept]).alias("row")
    rows = docs.select(
        F.coalesce(named(key).cast("long"), F.lit(NO_KEY)).alias("gone_key"), F.xxhash64(named(text)).alias("gone_print"), row
    )
    ranges = gone.select("gone_key", "gone_print", _merged(F.col("gone")).alias("ranges"))
    joined = rows.join(ranges.hint("shuffle_hash"), ["gone_key", "gone_print"], "left")
    # Two references each below keep `lines` and `gaps` from being inlined into the lambdas and made anew per element.
    split = joined.withColumn("lines", F.split(F.col("row")[text], "\n"))
    stops = F.concat("ranges", F.array(F.struct(F.size("lines").alias("start"), F.size("lines").alias("end"))))
    between = lambda r, k: F.struct(F.coalesce(F.get("ranges", k - 1)["end"], F.lit(0)).alias("from"), r["start"].alias("to"))
    gaps = split.withColumn("gaps", F.transform(stops, between))
    left = F.flatten(F.transform("gaps", lambda g: F.slice("lines", g["from"] + 1, g["to"] - g["from"])))
    cleaned = F.when(F.col("ranges").isNull(), F.col("row")[text]).otherwise(F.array_join(left, "\n"))
    removed = F.size("lines") - F.aggregate("gaps", F.lit(0), lambda n, g: n + g["to"] - g["from"])
    return gaps.select(
        *[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in kept],
        F.when(F.col("row")[text].isNull(), 0).otherwise(F.size("lines")).alias("lines_total"),
        F.when(F.col("ranges").isNull(), 0).otherwise(removed).alias("lines_removed"),
    )


def with_units(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `lines` and `units`, an array of (start, size, id): all that a repeated passage can consist of.

    For each line with words these are the shortest run from it on and the
    shortest run up to it of more than `LONG_WORDS` words. Both depend on their
    own lines only, and any passage of more words is covered by those inside it,
    whatever stands around it. The removable chunks of `with_chunks` are units
    too. `id` is the SHA-256 of a unit's bytes.
    """
    known = with_chunks(docs, text)
    facts = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(r"\S+")).alias("words")))
    full = known.withColumn("full", F.filter(facts, lambda f: f["words"] > 0))
    packed = lambda start, size: start.cast("long") * F.lit(1 << 31) + size

    # Places are read by number: a slice inside a lambda would copy the whole array each time.
    def reach(places: Column) -> Column:
        none = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("i"))
        add = lambda at, f: F.struct((at["words"] + f["words"]).alias("words"), f["i"].alias("i"))
        step = lambda at, x: F.when(at["words"] > LONG_WORDS, at).otherwise(add(at, F.get("full", x)))
        end = F.aggregate(places, none, step)
        return F.when(end["words"] > LONG_WORDS, end["i"])

    # Every line here has a word, so no run is longer than LONG_WORDS + 1 of them.
    last = lambda k: F.least(k + LONG_WORDS, F.size("full") - 1)
    since = lambda k: F.greatest(k - LONG_WORDS, F.lit(0))
    ahead = F.transform("full", lambda f, k: F.struct(f["i"].alias("start"), reach(F.sequence(k, last(k))).alias("end")))
    behind = F.transform("full", lambda f, k: F.struct(reach(F.sequence(k, since(k))).alias("start"), f["i"].alias("end")))
    runs = lambda x: F.transform(
        F.filter(x, lambda r: r["start"].isNotNull() & r["end"].isNotNull()), lambda r: packed(r["start"], r["end"] - r["start"] + 1)
    )
    chunks = F.transform(F.filter("chunks", _removable), lambda c: packed(c["start"], c["size"]))
    spans = full.withColumn("spans", F.array_union(F.array_union(runs(ahead), runs(behind)), chunks)).drop("full", "chunks")

    def unit(span: Column) -> Column:
        start, size = F.shiftright(span, 31).cast("int"), span.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        own = F.transform(F.sequence(start, start + size - 1), lambda i: F.get("lines", i))
        digest = F.unhex(F.sha2(F.array_join(own, "\n"), 256))
        return F.struct(start.alias("start"), size.alias("size"), digest.alias("id"))

    return spans.withColumn("units", F.transform("spans", unit)).drop("spans")


def drop_repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the lines of repeated passages, and `lines_total`, `lines_removed`.

    Every run of whole lines with more than `LONG_WORDS` words that stands at an
    earlier place too goes whole, whatever lines are before or behind it in
    either document (`with_units`), and so do the chunks that
    `drop_repeated_chunks` removes. The earliest place is that of the smallest
    key, in it of one text after another, in it of the first line. A run that
    overlaps its own first occurrence stays. Units meet by the SHA-256 of their
    bytes, which stands for comparing them.

    One row of some 70 bytes per unit moves, about one or two units per line;
    texts of very short lines have as many, with runs of up to 51 lines to
    hash for each. Nulls, repeated rows, empty tables and columns are dealt with
    as in `drop_repeated_chunks`.
    """
    own = docs.select(
        F.coalesce(named(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(named(text)).alias("print"), named(text).alias("text")
    )
    # A plain explode gets a filter on its array, which is pushed below and makes the lines anew for each unit.
    placed = with_units(own, "text").select("key", "print", F.explode_outer("units").alias("unit")).filter("unit IS NOT NULL")
    placed = written(placed.select("key", "print", "unit.start", "unit.size", "unit.id"))
    place = F.struct("key", "print", "start")
    repeated = placed.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    # Stored, so that the join deals both sides anew and can split a large group.
    repeated = written(repeated.select("id", "first"))
    same = (F.col("key") == F.col("first.key")) & (F.col("print") == F.col("first.print"))
    kept = same & (F.col("start") < F.col("first.start") + F.col("size"))
    gone = (
        placed.join(repeated, "id")
        .filter(~kept)
        .groupBy(F.col("key").alias("gone_key"), F.col("print").alias("gone_print"))
        .agg(F.collect_set(F.struct("start", "size")).alias("gone"))
    )
    return _without(docs, gone, key, text)


_LINES = f"""
own AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM own),
fact AS (
  SELECT doc_id, line, i, ('0x' || substr(md5(line), 1, 15))::BIGINT % {MODULUS} AS h,
         length(line) - length(replace(line, ' ', '')) + 1 AS words FROM line),
edge AS (
  SELECT *, i = 0 OR words > {LONG_WORDS} OR lag(words) OVER w > {LONG_WORDS}
         OR (coalesce(lag(h, 2) OVER w, 0) * 31 + lag(h) OVER w) % {MODULUS} % {SHARE} = 0 AS starts
  FROM fact WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
part AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM edge),
chunk AS (
  SELECT doc_id, chunk, min(i) AS start, count(*) AS size, sum(words) AS words,
         string_agg(line, chr(10) ORDER BY i) AS bytes FROM part GROUP BY doc_id, chunk),
removable AS (SELECT * FROM chunk WHERE size >= 2 AND words >= {LEAST_WORDS} OR words > {LONG_WORDS})"""

# What the two operators give for doc_id and text, for distinct documents, in the SQL of the check.
CHUNKS_SQL = f"""
WITH {_LINES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) AS place FROM removable),
gone AS (SELECT doc_id, chunk FROM ranked WHERE place > 1),
left_over AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE g.chunk IS NULL) AS text,
         count(*) FILTER (WHERE g.chunk IS NOT NULL) AS removed, count(*) AS total
  FROM part p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.chunk = p.chunk GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text,
       coalesce(l.total, 0)::INT AS lines_total, coalesce(l.removed, 0)::INT AS lines_removed
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""

# A line goes if a run of whole lines around it, of more than LONG_WORDS words, stands at an earlier place too. Every such
# run is covered by those in it that lose that many words with their first or their last line.
PASSAGES_SQL = f"""
WITH {_LINES},
worded AS (
  SELECT doc_id, i, len(regexp_extract_all(line, '[^ \t\n\x0b\f\r]+')) AS n FROM line),
numbered AS (
  SELECT *, row_number() OVER w AS k, sum(n) OVER w AS upto FROM worded WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (
  SELECT a.doc_id, a.i AS start, min(b.i) AS stop FROM numbered a JOIN numbered b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {LONG_WORDS} AND b.upto - a.upto + a.n > {LONG_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS start, b.i AS stop FROM numbered a JOIN numbered b
    ON a.doc_id = b.doc_id AND a.k BETWEEN b.k - {LONG_WORDS} AND b.k AND b.upto - a.upto + a.n > {LONG_WORDS} GROUP BY b.doc_id, b.i
  UNION
  SELECT doc_id, start, start + size - 1 AS stop FROM removable),
unit AS (
  SELECT r.doc_id, r.start, r.stop, array_to_string(list_slice(o.lines, r.start + 1, r.stop + 1), chr(10)) AS bytes
  FROM run r JOIN own o USING (doc_id)),
placed AS (SELECT *, min((doc_id, start)) OVER (PARTITION BY bytes) AS first FROM unit),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM placed
  WHERE NOT (doc_id = first[1] AND start < first[2] + (stop - start + 1))),
left_over AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) FILTER (WHERE g.i IS NOT NULL) AS removed, count(*) AS total
  FROM line p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text,
       coalesce(l.total, 0)::INT AS lines_total, coalesce(l.removed, 0)::INT AS lines_removed
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""
