"""Line deduplication with a segment-partition edit join, in DataFrame functions only.

A line is removed from a document if an equal line, or one within ``EDITS`` edits where both have ``LEAST`` characters, stands earlier
in the corpus, in the order of ``doc_id`` and line. Equal lines meet by hash. For the others, each distinct line is split into
``EDITS + 1`` segments of even lengths, of which a line within the threshold keeps at least one unchanged; it is then found among the
substrings of that line at the few places that the difference of lengths allows; the rest of both is split in the same way again, so
that lines which merely share a segment rarely meet. Where more than ``HOT`` lines have a key all the same, as those of one template
have, the rest of both is split again and again, until few agree or a character is left of each. Both sides carry one hash of
(length, segments, substrings); where they meet, the texts of the two lines are fetched and their edit distance is taken within the
threshold's band.

The band is computed by Spark's own thresholded ``levenshtein``; a bit-parallel form would need bit operations per character in
interpreted higher-order functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import quoted, small, unused, written

EDITS = 1
LEAST = 16  # characters; shorter lines with a word go by equality alone
#: For a threshold that grows: from so many characters of the shorter line on, so many edits, up to three; ascending.
GROWING = ((LEAST, 1), (40, 2), (60, 3))
WORD = r"[^\x20\x09-\x0D]"
HOT = 64  # lines under one key that may be compared one by one


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First character (from 1) and length of segment ``i`` (from 0) of a line: the last ones are the longer ones."""
    size = F.shiftright(length, 1) if edits == 1 else F.floor(length / (edits + 1)).cast("int")
    if i == 0:
        return F.lit(1), size
    start, longer = 1 + i * size, length % (edits + 1)
    if i > 1:
        start = start + F.greatest(F.lit(0), longer - (edits + 1 - i))
    return start, length - start + 1 if i == edits else size + F.when(longer >= edits + 1 - i, 1).otherwise(0)


def _matches(text: Column, length: Column, n: Column, shorter: int, edits: int) -> list[tuple[bool, int, Column, Column]]:
    """For a line of ``length`` that looks for lines of ``n``, ``shorter`` characters less: each segment at each place where it can
    match, as (whether it is the line's own segment, its number, the substring, the rest of the line).

    A segment matches at places that leave the edits before it below its number and those after it below what then remains. Nothing is
    left before the first segment, and nothing after the last one if all that the line has more stands before it.
    """
    out = []
    for i in range(edits + 1):
        start, size = _segment(n, i, edits)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
            at = start + shift if shift else start
            before = [F.substring(text, F.lit(1), at - 1)] if i > 0 else []
            after = [F.substring(text, at + size, length)] if i < edits or shift < shorter else []
            rest = F.concat(*before, *after) if before and after else (before + after)[0]
            out.append((shorter == 0 and shift == 0, i, F.substring(text, at, size), rest))
    return out


def _keyed(lines: DataFrame, edits: int | tuple[tuple[int, int], ...]) -> DataFrame:
    """``lines`` with the hashes under which a line is found (``own``), and under which it looks for others (``probes``): lines of its own
    length and up to as many characters shorter as there may be edits. Shorter lines than ``LEAST`` meet by their hash only and have none.

    What is left of two lines without a matching segment is within the same number of edits, so that it is split into segments once
    more: a key is a segment and a segment of the rest. Lines that share one segment but differ in more places don't meet.
    Thresholds that grow are split once only above one edit, since both splits make more expressions than a driver compiles.

    Segments and rests are columns of their own before they are hashed: Spark works out an expression under a condition anew wherever
    it is named, and the JVM doesn't compile a method of more than 8,000 bytes of code.
    """
    length, parts, own, probes = F.col("length"), [], [], []

    def part(value: Column, fits: Column | None) -> Column:
        parts.append((value if fits is None else F.when(fits, value)).alias(f"part{len(parts)}"))
        return F.col(f"part{len(parts) - 1}")

    for n_edits, within in _classes(edits):
        for shorter in range(n_edits + 1):
            n, fits = length - shorter if shorter else length, None
            if within is not None:
                low, high = within
                fits = n >= low if high is None else (n >= low) & (n < high)
            mine_too, others = [], []
            for mine, i, segment, rest in _matches(F.col("line"), length, n, shorter, n_edits):
                segment = part(segment, fits)
                if within is not None and n_edits > 1:
                    (mine_too if mine else others).append(F.xxhash64(n, F.lit(i), segment))
                    continue
                _, size = _segment(n, i, n_edits)
                for too, j, piece, _ in _matches(part(rest, fits), length - size, n - size, shorter, n_edits):
                    (mine_too if mine and too else others).append(F.xxhash64(n, F.lit(i), segment, F.lit(j), piece))
            for found, keys in ((own, mine_too), (probes, others)):
                if keys:
                    found.append(F.when(length >= LEAST if fits is None else (length >= LEAST) & fits, F.array(*keys)).otherwise(F.array().cast("array<long>")))
    own, probes = (keys[0] if len(keys) == 1 else F.concat(*keys) for keys in (own, probes))
    measured = lines.withColumn("length", F.length("line"))
    return measured.select(*lines.columns, "length", *parts).select(*lines.columns, own.alias("own"), probes.alias("probes"))


def _classes(edits: int | tuple[tuple[int, int], ...]) -> list[tuple[int, tuple[int, int | None] | None]]:
    """Each threshold with the lengths of the shorter line for which it holds; all lengths if there is but one."""
    if isinstance(edits, int):
        return [(edits, None)]
    ends = [low for low, _ in edits[1:]] + [None]
    return [(n, (low, high)) for (low, n), high in zip(edits, ends)]


def _near(a: Column, b: Column, edits: int | tuple[tuple[int, int], ...]) -> Column:
    """Whether two lines are within the threshold of the shorter one."""
    out, shorter = F.lit(False), F.least(F.length(a), F.length(b))
    for n, within in _classes(edits):
        near = F.levenshtein(a, b, n) >= 0
        out = near if within is None else F.when(shorter >= within[0], near).otherwise(out)
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no`` (from 1) and ``line`` of every line that is long enough for an edit, and of each shorter one with a word."""
    split = F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("at", "line")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), split)
    return rows.where((F.length("line") >= LEAST) | F.col("line").rlike(WORD)).select("doc_id", (F.col("at") + 1).alias("line_no"), "line", *_name(F.col("line")))


def _name(line: Column) -> tuple[Column, Column]:
    """128 bits by which lines are told apart."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")


def _details(shorter: int, within: tuple[int, int | None] | None) -> Column:
    """The keys of ``_keyed`` for one edit and lines ``shorter`` characters less, each with what is left of the line: ``key, shorter, mine, rest``."""
    length, found = F.length("line"), []
    n = length - shorter
    for mine, i, segment, rest in _matches(F.col("line"), length, n, shorter, 1):
        _, size = _segment(n, i, 1)
        for too, j, piece, left in _matches(rest, length - size, n - size, shorter, 1):
            key = F.xxhash64(n, F.lit(i), segment, F.lit(j), piece)
            if within is not None:
                low, high = within
                key = F.when(n >= low if high is None else (n >= low) & (n < high), key)
            found.append(F.struct(key.alias("key"), F.lit(shorter).alias("shorter"), F.lit(mine and too).alias("mine"), left.alias("rest")))
    return F.array(*found)


def _split_again(rows: DataFrame) -> DataFrame:
    """Keys of one more segment: of two rests within an edit, one of two segments is the same."""
    cases = []
    for shorter in range(2):
        length = F.length("rest")
        parts = [
            F.struct(F.xxhash64("key", F.lit(i), segment).alias("key"), (F.col("mine") & F.lit(same)).alias("mine"), left.alias("rest"))
            for same, i, segment, left in _matches(F.col("rest"), length, length - shorter, shorter, 1)
        ]
        cases.append(F.array(*parts))
    return rows.select("x", "place", "shorter", F.explode(F.when(F.col("shorter") == 0, cases[0]).otherwise(cases[1])).alias("r")).select("x", "place", "shorter", "r.*")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ordered pairs of different lines that share a key."""
    met = left.select("key", F.col("x").alias("a")).join(right.select("key", F.col("x").alias("b")), "key").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _hot_pairs(rows: DataFrame) -> list[DataFrame]:
    """Pairs among lines of hot keys, about as many as there are lines: ``rows`` have ``x, place, key, shorter, mine, rest``.

    A key says which parts are equal and how long the rest is. Lines with one character left or none differ in nothing else, so that all
    but the first of them are beaten by the first: it alone is paired with the others. A line one longer meets the one that it is without
    a character.
    """
    out = []
    while True:
        rows = written(rows, "hot")
        sizes = rows.where("mine").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("place", "x")).alias("first"))
        known = rows.join(small(written(sizes, "sizes")), "key")
        ended = F.length("rest") <= 1 + F.col("shorter")
        star = known.where(ended & F.col("mine") & (F.col("x") != F.col("first.x")))
        out.append(star.select(F.least("x", "first.x").alias("a"), F.greatest("x", "first.x").alias("b")))
        exact = lambda rest: F.xxhash64("key", F.lit("rest"), rest).alias("key")
        without = F.array_distinct(F.array(F.expr("substring(rest, 2)"), F.expr("left(rest, length(rest) - 1)")))
        longer = known.where(ended & (F.col("shorter") == 1)).select("x", "key", F.explode(without).alias("rest"))
        out.append(_pairs(known.where(ended & F.col("mine")).select("x", exact(F.col("rest"))), longer.select("x", exact(F.col("rest")))))
        few = known.where(~ended & (F.col("m") <= HOT))
        out.append(_pairs(few.where("mine"), few))
        many = known.where(~ended & (F.col("m") > HOT))
        if many.isEmpty():
            return out
        rows = _split_again(many)


def repeated_lines(docs: DataFrame, edits: int | tuple[tuple[int, int], ...] = EDITS) -> DataFrame:
    """``doc_id, drop``: the numbers of the lines to remove, for each document that has any."""
    lines = _lines(docs)
    keyed = _keyed(lines, edits).drop("line")
    distinct = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "own", "probes")).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.select("h1", "h2", "n", "first.*"), "lines")

    index = distinct.select(F.explode("own").alias("key"), F.struct("h1", "h2").alias("x"))
    probe = distinct.select(F.explode(F.concat("own", "probes")).alias("key"), F.struct("h1", "h2").alias("x"))
    # Where one line of so many differs, one split leaves too much of a line for larger thresholds: only keys of one edit are split again.
    single = next((within for n, within in _classes(edits) if n == 1), False)
    hot = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select("key"), "hot-keys")
    if single is False or hot.isEmpty():
        pairs = _pairs(index, probe).distinct()
    else:
        ids = written(probe.join(small(hot), "key").select("x.*").distinct(), "hot-lines")
        told = lines.select("h1", "h2", "line").join(small(ids), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))
        told = told.join(distinct.select("h1", "h2", F.struct("doc_id", "line_no").alias("place")), ["h1", "h2"])
        told = written(told.select(F.struct("h1", "h2").alias("x"), "place", "line"), "hot-texts")
        rows = [told.select("x", "place", F.explode(_details(shorter, single)).alias("r")).select("x", "place", "r.*") for shorter in range(2)]
        rows = written(rows[0].unionByName(rows[1]).join(small(hot), "key"), "hot-rows")
        split = written(rows.select("key").distinct(), "split-keys")  # hot keys of other thresholds stay as they are
        rest = [side.join(small(split), "key", "left_anti") for side in (index, probe)]
        pairs = reduce(DataFrame.unionByName, _hot_pairs(rows), _pairs(*rest)).distinct()
    pairs = small(written(pairs, "pairs"))
    wanted = small(written(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct().select("x.*"), "wanted"))
    places = distinct.select("h1", "h2", F.struct("doc_id", "line_no").alias("place")).join(wanted, ["h1", "h2"])
    found = lines.select("h1", "h2", "line").join(wanted, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    found = found.join(places, ["h1", "h2"]).select(F.struct("h1", "h2").alias("x"), "line", "place")
    found = written(found, "texts")

    def side(name: str) -> DataFrame:
        return found.select(F.col("x").alias(name), F.col("line").alias(f"line_{name}"), F.col("place").alias(f"place_{name}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_near(F.col("line_a"), F.col("line_b"), edits))
    beaten = near.select(F.when(F.col("place_a") > F.col("place_b"), F.col("a")).otherwise(F.col("b")).alias("x")).distinct()
    beaten = small(written(beaten.select("x.h1", "x.h2", F.lit(True).alias("beaten")), "beaten"))
    judged = distinct.select("h1", "h2", "n", F.struct("doc_id", "line_no").alias("first")).join(beaten, ["h1", "h2"], "left")
    judged = judged.where("n > 1 OR beaten").drop("n")
    places = lines.select("doc_id", "line_no", "h1", "h2").join(judged, ["h1", "h2"])
    gone = places.where(F.coalesce("beaten", F.lit(False)) | (F.struct("doc_id", "line_no") > F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))


def remove_repeated_lines(docs: DataFrame, edits: int | tuple[tuple[int, int], ...] = EDITS) -> DataFrame:
    """All columns of ``docs`` with ``text`` shortened, and ``lines_before`` and ``lines_removed``.

    docs: ``doc_id`` and ``text``. Lines end at ``\\n``; those of fewer than ``LEAST`` characters go if they have a word and an equal
    line stands earlier; shorter ones without a word, such as blank lines, stay.
    edits: one threshold for all lines, or pairs like ``GROWING``. A null text stays null and has no line.
    Rows without ``doc_id`` neither lose lines nor cost others any; rows with the same ``doc_id`` count as one document, so that a line at
    the same place of both stays in both. Further columns are passed on; columns named like the two added ones are replaced.
    """
    drops = small(written(repeated_lines(docs, edits), "drops"), 4 * F.size("drop"))
    key, gone = unused(docs, "_key"), unused(docs, "_gone")
    drops = drops.select(F.col("doc_id").alias(key), F.col("drop").alias(gone))
    split, numbers = unused(docs, "_split"), unused(docs, "_numbers")
    joined = docs.join(drops, F.col("doc_id").cast("long") == F.col(key), "left")
    # Split once, as a column: what a lambda names is worked out for every element.
    joined = joined.withColumn(split, F.split(F.col("text").cast("string"), "\n", -1))
    joined = joined.withColumn(numbers, F.array_except(F.sequence(F.lit(1), F.size(split)), F.col(gone)))
    shorter = F.array_join(F.transform(numbers, lambda i: F.element_at(split, i)), "\n")
    new = {
        "text": F.when(F.col(gone).isNull(), F.col("text").cast("string")).otherwise(shorter),
        "lines_before": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long"),
        "lines_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }
    names = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    return joined.select(*(new[c].alias(c) if c == "text" else F.col(quoted(c)) for c in names), *(new[c].alias(c) for c in ("lines_before", "lines_removed")))


#: The threshold of one edit by deletion: lines of one length differ in one character if both are equal without the character at that
#: place; a line one shorter is the longer one without a character.
LINES_SQL = f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM split),
long AS (SELECT * FROM lines WHERE length(line) >= {LEAST} OR regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM long),
firsts AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS place, line FROM ranked WHERE nth = 1),
cut AS (SELECT place, length(line) AS n, p, hash(left(line, p - 1) || substr(line, p + 1)) AS h FROM (SELECT *, unnest(range(1, length(line) + 1)) AS p FROM firsts WHERE length(line) >= {LEAST})),
near AS (
  SELECT a.place AS x, b.place AS y FROM cut a JOIN cut b ON a.h = b.h AND a.p = b.p AND a.n = b.n AND a.place < b.place
  UNION ALL SELECT least(a.place, f.place), greatest(a.place, f.place) FROM cut a JOIN firsts f ON a.h = hash(f.line) WHERE length(f.line) >= {LEAST}),
gone AS (SELECT doc_id, line_no FROM ranked WHERE nth > 1
  UNION SELECT r.doc_id, r.line_no FROM ranked r JOIN firsts f ON r.line = f.line AND r.nth = 1 WHERE f.place IN (SELECT y FROM near)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM split d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
