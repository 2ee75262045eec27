"""Text operators against plain versions, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import forest, graph, lines, minhash, mixing, neighbours, packing, quality, rules, statistics, substrings, suffixes, tables, toxicity, words
from tessella.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, starts string, bands int, key string, label string, component string, `drop` int, gone int"


@pytest.fixture(scope="module", autouse=True)
def settings_of_text(spark):
    tables.prepared(spark)


def table_of(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, ["en", None, "de"][k % 3], ["a", "b", None][k % 3], len(t or ""), "x", 1, "k", "l", "c", 5, 1) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    texts = [None, "", " \t\n ", "one", "a b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n o", long, long + " end", "ß   é x", "twice", "twice", "no id", None]
    return table_of(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None, None])


def babble(seed, n, vocabulary, longest, alphabet="ab"):
    r = random.Random(seed)
    names = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 3))) for _ in range(vocabulary)]
    out = [r.choice(" \n").join(r.choice(names) for _ in range(r.randint(0, longest))) for _ in range(n)]
    return out + [out[0], out[1] + " " + out[2]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB é\n\t  z"))), max_size=8), st.integers(1, 12))
def test_words_are_those_of_the_pattern(texts, size):
    batch = pa.array(texts, pa.string())
    seen = []
    for chunk in words.chunks(batch, size):
        found = words.split_words(chunk)
        data = chunk.data.tobytes()
        for d in range(len(chunk)):
            seen.append([data[a:b].decode() for a, b in zip(found.start[found.first[d] : found.first[d + 1]], found.stop[found.first[d] : found.first[d + 1]])])
        names = [data[a:b] for a, b in zip(found.start, found.stop)]
        hashes = words.hash_words(chunk, found)
        assert len({(n, h) for n, h in zip(names, hashes.tolist())}) == len(set(names)) == len(set(hashes.tolist()))
    assert seen == [WORD.findall(t or "") for t in texts]


def test_statistics(spark):
    texts = ["The a a a a a # b.\nsame line\nsame line\n\n12", "É<é>|", "", None, "a b a b a b a b"]
    got = {r.doc_id: r for r in statistics.count_documents(table_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, ls, r = WORD.findall(t), t.split("\n"), got[i]
        seen, dup = set(), 0
        for x in ls:
            dup += bool(WORD.search(x)) and x in seen
            seen.add(x)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls), dup, len(twice))
        assert (r.n_distinct_words, r.n_upper, r.n_wide) == (len(set(w)), sum("A" <= c <= "Z" for c in t), sum(ord(c) > 127 for c in t))


def test_encoder_gives_the_ids_of_the_vocabulary_file():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    plain, ours = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["", " ", "a  b", "a \n b\n\n", "it's <|endoftext|> here<|endoftext|>", "x y  z", "12345 ÄÖ ñandú 漢字 🙂", "\x1c\x85\tq", "end "]
    texts += [chr(c) + "a " + chr(c) for c in (0x0B, 0x1F, 0xA0, 0x1680, 0x2028, 0x3000, 0x200B, 0xFEFF)]
    for t in texts:
        assert ours.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_restores_every_document(spark):
    docs = awkward(spark)
    encode = packing.Encoder(packing.default_vocabulary()).ids
    want = Counter((r.doc_id, *encode(r.text or "").tolist(), 0) for r in docs.collect())
    rows = packing.pack_documents(docs, capacity=64).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for p in places.values():
        ends = 0
        for offset, length in sorted(p):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert sum(64 - sum(n for _, n in p) for p in places.values()) < 64
    # Documents of one id can't be told apart by their pieces: the ids by document, each as often as it was given.
    by_id = defaultdict(Counter)
    for (i, *ids), n in want.items():
        for x in ids:
            by_id[i][x] += n
    got = defaultdict(Counter)
    for r in rows:
        got[r.doc_id].update(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == by_id
    single = [r for r in rows if r.doc_id == 6]
    assert [x for r in sorted(single, key=lambda r: r.start) for x in np.frombuffer(bytes(r.ids), "<u4").tolist()] == [*encode(docs.where("doc_id = 6").first().text).tolist(), 0]


def test_packing_balances_cost():
    lengths = np.array(sorted([random.Random(1).randint(1, 1000) for _ in range(300)], reverse=True))
    placed = packing.assign(lengths, 1024)
    cost, fill = Counter(), Counter()
    for _, _, n, s, _ in placed:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
        fill[s] += n
    assert sum(fill.values()) == lengths.sum() and max(fill.values()) <= 1024
    naive = Counter()
    at = 0
    for n in lengths.tolist():  # next fit, cut at the end of each sequence
        while n:
            take = min(n, 1024 - at % 1024)
            naive[at // 1024] += packing.LINEAR * take + packing.QUADRATIC * take * take
            at, n = at + take, n - take
    assert np.std(list(cost.values())) < np.std(list(naive.values()))


def plain_substrings(docs, window):
    word = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(word):
        for k in range(len(word[i]) - window + 1):
            first.setdefault(tuple(word[i][k : k + window]), i)
    out = {}
    for i, w in word.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    texts = babble(seed, 60, 6, 40)
    ids = random.Random(seed).sample(range(10**12), len(texts))
    docs = table_of(spark, texts, ids).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeated_windows(docs, 3).collect()}
    assert got == plain_substrings(list(zip(ids, texts)), 3)
    whole = {r.doc_id: r.n_removed for r in substrings.remove_repeated_windows(awkward(spark)).collect() if r.doc_id is not None}
    assert whole == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 15, 6: 0, 7: 40_000, 8: 0, 9: 0}


def plain_suffixes(docs, depth):
    data = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[k : k + depth] for b in data.values() for k in range(len(b) - depth + 1))
    out = {}
    for i, b in data.items():
        gone = {k + j for k in range(len(b) - depth + 1) if seen[b[k : k + depth]] > 1 for j in range(depth)}
        out[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), bytes(x for k, x in enumerate(b) if k not in gone))
    return out


@pytest.mark.parametrize("seed,depth,step,gram", [(1, 12, 4, 5), (2, 20, 5, 6), (3, 9, 3, 3)])
def test_suffixes(spark, seed, depth, step, gram):
    texts = babble(seed, 40, 30, 40, "abé") + ["xy" * 30, "z" * 50, "", "short"]
    docs = table_of(spark, texts, [3 * i for i in range(len(texts))]).repartition(3)
    rows = suffixes.remove_repeated_bytes(docs, depth, step, gram).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in rows}
    assert got == plain_suffixes([(3 * i, t) for i, t in enumerate(texts)], depth)


def test_suffixes_of_awkward_rows(spark):
    got = [(r.doc_id, r.n_removed == r.n_bytes) for r in suffixes.remove_repeated_bytes(awkward(spark)).collect()]
    # The two long texts repeat: all of them but the added end.
    assert Counter(got) == Counter({(0, True): 1, (1, True): 1, (2, False): 1, (3, False): 1, (4, False): 1, (5, False): 1, (6, True): 1, (7, False): 1, (8, False): 1, (9, False): 2, (None, False): 1, (None, True): 1})


def plain_classes(docs, percent=minhash.PERCENT):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_minhash(spark):
    r = random.Random(4)
    base = [[f"W{r.randint(0, 400)}" for _ in range(r.choice([6, 12, 40, 150, 400]))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(10):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
            texts.append(" ".join(w) if r.random() < 0.8 else " ".join(w).lower())
    texts += ["one two", "One TWO", "", None, "a b c d e", "a b c d f"]
    docs = list(enumerate(texts))
    r.shuffle(docs)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(table_of(spark, [t for _, t in docs], [i for i, _ in docs])).collect()}
    assert got == plain_classes(docs)


def test_minhash_of_awkward_rows(spark):
    rows = minhash.near_duplicates(awkward(spark)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter(
        {(i, {5: 4, 7: 6}.get(i, i), i not in (5, 7)): 2 if i == 9 else 1 for i in range(10)} | {(None, None, True): 2}
    )
    left = minhash.distinct_documents(awkward(spark))
    assert left.columns == awkward(spark).columns and sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 9]


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1001 + i) for i in range(50)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)]
    r.shuffle(edges)
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    alone = {x for x in parent} - {x for a, b in edges if a != b for x in (a, b)}
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((f.node, f.component) for f in found) == sorted((n, c) for n, c in parent.items() if n not in alone)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(spark, edits):
    r = random.Random(edits)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(14, 40))) for _ in range(12)]

    def near(s):
        s = list(s)
        for _ in range(r.randint(0, edits + 1)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], ["x"], [s[k], "y"]])
        return "".join(s)

    docs = [(i, "\n".join(near(r.choice(base)) if r.random() < 0.7 else f"short {i}" for _ in range(r.randint(1, 6)))) for i in range(40)]
    got = {x.doc_id: x.text for x in lines.remove_repeated_lines(table_of(spark, [t for _, t in docs]), edits).collect()}
    before, short, want = [], set(), {}
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            if len(line) >= lines.LEAST:
                if not any(edit_distance(line, x) <= edits for x in before):
                    kept.append(line)
                before.append(line)
            else:
                if line not in short or not line.strip():
                    kept.append(line)
                short.add(line)
        want[i] = "\n".join(kept)
    assert got == want


def test_lines_of_awkward_rows(spark):
    got = lines.remove_repeated_lines(awkward(spark))
    assert got.columns == [*awkward(spark).columns, "lines_before", "lines_removed"]
    assert Counter((r.doc_id, r.text is None, r.lines_removed) for r in got.collect()) == Counter(
        [(0, True, 0), (1, False, 0), (2, False, 0), (3, False, 0), (4, False, 0), (5, False, 1), (6, False, 0), (7, False, 0), (8, False, 0), (9, False, 0), (9, False, 0), (None, False, 0), (None, True, 0)]
    )


def test_lines_within_a_growing_threshold(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcé ") for _ in range(n)) for n in (15, 16, 17, 30, 38, 39, 40, 41, 43, 57, 58, 60, 61, 62, 90) for _ in range(2)]

    def near(s):
        s = list(s)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], ["x"], [s[k], "y"]])
        return "".join(s)

    docs = [(i, "\n".join(near(r.choice(base)) for _ in range(8))) for i in range(40)]
    most = lambda n: max((e for low, e in lines.GROWING if n >= low), default=0)
    before, want, by = [], {}, Counter()
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            found = [edit_distance(line, x) for x in before if edit_distance(line, x) <= most(min(len(line), len(x)))]
            if not found:
                kept.append(line)
            else:
                by[min(found)] += 1
            before.append(line)
        want[i] = "\n".join(kept)
    got = {x.doc_id: x.text for x in lines.remove_repeated_lines(table_of(spark, [t for _, t in docs]), lines.GROWING).collect()}
    assert got == want and all(by[n] for n in range(4))


def test_every_repeated_line_goes(spark):
    """Short lines go by equality alone, longer ones within an edit too; blank lines and short near copies stay."""
    texts = ["Read more\nlong enough to be compared\n\n阅读更多", "Read mora\nRead more\n \n\n阅读更多\n!\n!", "long enough to be compares\nRead more\nnew", None, ""]
    want = ["Read more\nlong enough to be compared\n\n阅读更多", "Read mora\n \n\n!", "new", None, ""]
    docs = table_of(spark, texts)
    got = {r.doc_id: (r.text, r.lines_removed) for r in lines.remove_repeated_lines(docs).collect()}
    assert got == {i: (w, n) for i, (w, n) in enumerate(zip(want, (0, 3, 2, 0, 0)))}


def test_lines_make_short_code(spark, monkeypatch, capsys):
    """Code of the keys that the JVM compiles (8,000 bytes a method at most), and a text that isn't split anew for each of its lines."""
    made = {}
    monkeypatch.setattr(lines, "written", lambda df, name: made.setdefault(name, df) and tables.written(df, name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lines.remove_repeated_lines(table_of(spark, ["a line of some words\na line of some wordz\nx", "x\n\na line of some words"]))
        made["lines"].explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        found.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
    assert "lambdafunction(" in plan and not re.search(r"lambdafunction\([^)]*split\(", plan)
    assert {r.doc_id: r.text for r in found.collect()} == {0: "a line of some words\nx", 1: ""}


def test_mixing_meets_its_margins(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * r.randint(1, 60), r.choice("aaaabbc"), r.choice(["en", "en", "de"])) for i in range(3000)], "doc_id long, text string, source string, lang string")
    topics = docs.select("doc_id", (F.col("doc_id") % 3).alias("topic"))
    rows = mixing.mix_documents(docs, topics, budget=0.3).toPandas()
    total = rows.n_tokens.sum()
    for m in mixing.MARGINS:
        share = rows.groupby(m).n_tokens.sum() / total
        goal = share**mixing.TEMPERATURE / (share**mixing.TEMPERATURE).sum()
        expected = (rows.n_tokens * rows.probability).groupby(rows[m]).sum() / total / 0.3
        assert np.allclose(expected, goal, atol=1e-6)
        sampled = rows[rows.sampled].groupby(m).n_tokens.sum() / rows[rows.sampled].n_tokens.sum()
        assert np.allclose(sampled, goal, atol=0.05)
    assert rows.probability.max() <= 1


def skewed(spark):
    """Rare sources, languages and topics need far more than their tokens times 4 / 3 at the production budget."""
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 60), r.choice("a" * 40 + "bbbc"), r.choice(["en"] * 30 + ["de", "fr"]), r.choice([0] * 20 + [1, 2])) for i in range(4000)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    return rows.drop("topic"), rows.where("topic > 0").select("doc_id", "topic")


def test_mixing_meets_skewed_margins_with_production_parameters(spark):
    docs, topics = skewed(spark)
    rows = mixing.mix_documents(docs, topics).toPandas()
    total = rows.n_tokens.sum()
    expected = rows.n_tokens * rows.probability
    assert rows.probability.max() == pytest.approx(1) and rows.probability.max() <= 1 and 0 < expected.sum() / total < mixing.BUDGET
    for m in mixing.MARGINS:
        share = rows.groupby(m).n_tokens.sum() / total
        goal = share**mixing.TEMPERATURE / (share**mixing.TEMPERATURE).sum()
        assert np.allclose(expected.groupby(rows[m]).sum() / expected.sum(), goal, rtol=1e-5)


def cells_of(docs, topics):
    """Cells with their tokens, one for each combination of values that occurs."""
    return docs.join(topics, "doc_id", "left").groupBy("source", "lang", F.coalesce("topic", F.lit(-1)).cast("long").alias("topic")).agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("tokens"))


def test_mixing_by_windows_equals_mixing_by_sums(spark, monkeypatch):
    cells = cells_of(*skewed(spark))
    rates = lambda: {(r.source, r.lang, r.topic): r.probability for r in mixing.rake(cells, tolerance=1.0)[0].collect()}
    few = rates()
    monkeypatch.setattr(mixing, "FEW", 0)
    many = rates()
    assert few.keys() == many.keys() and all(abs(p - many[c]) < 1e-8 for c, p in few.items())


def test_mixing_says_which_margins_exclude_each_other(spark):
    """Sources of one language each can't have shares that differ from their language's."""
    cells = spark.createDataFrame([("a", "en", -1, 50), ("b", "de", -1, 70)], "source string, lang string, topic long, tokens long")
    targets = spark.createDataFrame([("lang", "en", 1.0), ("lang", "de", 1.0), ("source", "a", 3.0), ("source", "b", 1.0)], "margin string, value string, weight double")
    with pytest.warns(UserWarning, match="missed"):
        rows = mixing.rake(cells, targets=targets, most=6)[0].collect()
    assert len(rows) == 2 and all(0 < r.probability <= 1 for r in rows)


def test_mixing_takes_targets(spark):
    docs, topics = skewed(spark)
    targets = spark.createDataFrame([("lang", "en", 2.0), ("lang", "de", 1.0), ("lang", "fr", 1.0), ("lang", "absent", 9.0)], "margin string, value string, weight double")
    rows = mixing.mix_documents(docs, topics, targets=targets).toPandas()
    expected = (rows.n_tokens * rows.probability).groupby(rows.lang).sum()
    assert np.allclose((expected / expected.sum())[["en", "de", "fr"]], [0.5, 0.25, 0.25], rtol=1e-5)
    with pytest.raises(ValueError):
        mixing.mix_documents(docs, topics, targets=targets.where("value <> 'de'"))
    none = mixing.mix_documents(docs.where("false"), topics)
    assert none.count() == 0


def test_mixing_of_awkward_rows(spark):
    rows = mixing.mix_documents(awkward(spark)).collect()
    assert len(rows) == 13 and all(0 <= r.probability <= 1 for r in rows) and {r.lang for r in rows} == {"en", "", "de"}
    left = mixing.sampled_documents(awkward(spark))
    assert left.columns == awkward(spark).columns
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in left.collect()), key=key) == sorted((r.doc_id for r in rows if r.sampled), key=key)


def test_certified_bounds_are_exact():
    def upper_tail(k, n, p):
        return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n, k in [(10, 0), (300, 0), (300, 2), (900, 1), (500, 3), (40, 2)]:
        for risk in (0.004, 0.01, 0.05):
            for level in (0.3, 0.01, 0.0001):
                assert rules.certified(k, n, risk, level) == (k <= risk * n and upper_tail(k, n, risk) <= level)
    assert not rules.certified(5, 5, 0.05, 0.1) and not rules.certified(0, 0, 0.05, 0.1)


def test_rules_limit_false_rejection(spark):
    r = random.Random(8)
    texts, labels = [], []
    for i in range(3000):
        good = r.random() < 0.8
        word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
        texts.append(" ".join(word() + ("" if good and r.random() < 0.999 else "###") for _ in range(20)))
        labels.append((i, int(good)))
    docs = table_of(spark, texts).withColumn("lang", F.lit("en"))
    rows = rules.apply_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas().set_index("doc_id")
    good = np.array([q for _, q in labels], bool)
    kept = rows.kept.sort_index().to_numpy()
    assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.05
    few = rules.apply_rules(awkward(spark), spark.createDataFrame([(4, 1), (None, 1), (5, None)], "doc_id long, quality int")).collect()
    assert Counter((x.doc_id, x.base_failed, x.kept) for x in few) == Counter({(i, i not in (4, 5), i in (4, 5)): 2 if i == 9 else 1 for i in range(10) if i not in (6, 7)} | {(6, True, False): 1, (7, True, False): 1, (None, True, False): 2})


def test_forest_learns_and_survives_one_label():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 4))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] > 0)).astype(float)
    fit = forest.train(rows[:2000], labels[:2000])
    assert ((fit.score(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.95
    one = fit.score(rows[:1])  # a row alone takes the same way
    assert np.allclose(one, fit.score(rows)[:1])
    assert np.allclose(forest.train(rows[:5], np.ones(5)).score(rows), 6 / 7)
    assert np.allclose(forest.train(rows[:0], labels[:0]).score(rows[:2]), 0.5)


def accuracy(rows, labels, name):
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    return (held.predicted == held[name]).mean(), held


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    rows = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    share, _ = accuracy(rows, labels, "quality")
    assert share > 0.95


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    assert rows.score.between(0, 1).all() and (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    share, held = accuracy(rows, labels, "toxic")
    assert share > 0.95 and held[held.toxic == 0].predicted.mean() < 0.01
    bad, good = (held[held.toxic == k].score.to_numpy() for k in (1, 0))
    assert (bad >= 0.5).mean() > 0.75  # recall; labels are noisy
    assert (bad[:, None] > good[None, :]).mean() + (bad[:, None] == good[None, :]).mean() / 2 > 0.9  # area under the curve


def plain_near_lines(texts):
    """Of texts of one line each: whether an earlier one is within an edit."""
    seen, out = set(), []
    for line in texts:
        without = [line[:k] + line[k + 1 :] for k in range(len(line))]
        out.append(line in seen or any((k, v) in seen or v in seen for k, v in enumerate(without)) or ("longer", line) in seen)
        seen.add(line)
        seen.update(enumerate(without))
        seen.update(("longer", v) for v in without)
    return out


@pytest.mark.parametrize("n,digits", [(300, 8), (1500, 8), (700, 3)])
def test_template_lines_make_few_pairs(spark, monkeypatch, n, digits):
    """Lines that differ in a number of few digits: all pairs of them share keys, and few or (three digits) very many are near."""
    r = random.Random(n)
    texts = [f"This product page was rendered for visitor number {i:0{digits}d}" + (" of today" if digits == 3 else "") for i in r.sample(range(10**digits), n)]
    texts += [t[:20] + t[21:] for t in texts[:9]] + [t + "x" for t in texts[9:18]] + [t[:-1] + "z" for t in texts[18:27]] + ["x" + t for t in texts[:3]]
    r.shuffle(texts)
    made = {}
    monkeypatch.setattr(lines, "written", lambda df, name: made.setdefault(name, tables.written(df, name)) if name == "pairs" else tables.written(df, name))
    got = {x.doc_id: x.lines_removed for x in lines.remove_repeated_lines(table_of(spark, texts)).collect()}
    assert [bool(got[i]) for i in range(len(texts))] == plain_near_lines(texts)
    assert made["pairs"].count() < 4 * len(texts) if digits == 8 else made["pairs"].count() < 40 * len(texts)


def test_ftrl_equals_a_plain_loop():
    """Per coordinate, one feature after the other, as the update is written down."""
    r = random.Random(2)
    rows = [np.array(sorted(r.sample(range(40), r.randint(0, 12))), np.uint32) for _ in range(120)]
    labels = np.array([float(3 in row.tolist()) if r.random() < 0.9 else float(r.random() < 0.5) for row in rows])
    weights, bias = toxicity.learn(rows, labels, epochs=3, least=4)
    seen = Counter(x for row in rows for x in row.tolist())
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        hold = 0.0 if i == "constant" else toxicity.L1
        if abs(z[i]) <= hold:
            return 0.0
        return -(z[i] - math.copysign(hold, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for row, label in zip(rows, labels):
            at = [x for x in row.tolist() if seen[x] >= 4] + ["constant"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - step * w[i]
                n[i] += g * g
    assert bias == pytest.approx(weight("constant"))
    assert {i: weights[i] for i in np.flatnonzero(weights)} == pytest.approx({i: weight(i) for i in range(40) if weight(i)})


def test_classifiers_of_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1), (1, 0), (None, 1), (5, None), (4, 0)], "doc_id long, label int")
    none = labels.where("false")
    for score in (quality.classify, toxicity.score_toxicity):
        for given_labels in (labels, none):
            rows = score(awkward(spark), given_labels).collect()
            assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
        assert score(awkward(spark).where("false"), labels).count() == 0
    clash = awkward(spark).selectExpr("*", "1 AS __drop", "2 AS __key", "3 AS __gone", "4 AS _gone", "5 AS _key", "'u' AS `meta.url`", "6 AS c1", "7 AS `a``b`")
    for found in (quality.accepted(clash, labels, threshold=0.0), lines.remove_repeated_lines(clash).drop("lines_before", "lines_removed"), minhash.distinct_documents(clash), mixing.sampled_documents(clash)):
        assert found.columns == clash.columns and 0 < found.count() <= 13
    kept = quality.accepted(awkward(spark), labels, threshold=0.0)
    assert kept.columns == awkward(spark).columns and kept.count() == 13


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(9000, 12))
    data[100:140] = data[100]  # ties
    data[5000:] *= rng.uniform(0.2, 3, size=(4000, 1))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(data)]
    rows += [(20000, None, 1, "x"), (20020, [0.0] * 12, 1, "x"), (20040, [1.0] * 11 + [None], 1, "x"), (20060, [float("nan")] * 12, 1, "x"), (20080, [1.0] * 5, 1, "x"), (None, [1.0] * 12, 1, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, place string")
    got = defaultdict(list)
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 9000, 20))
    hit = 0
    for q, found in got.items():
        score = (data[q] * data).sum(1)
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], score[[f[1] for f in found]], rtol=1e-12)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        score[q] = -np.inf
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(len(data)), -score))[:20].tolist()))
    assert hit / (20 * len(got)) > 0.95
    few = neighbours.nearest(vectors.where("vec_id < 5"), F.col("vec_id") % 2 == 0, 20).collect()
    assert Counter(r.query_id for r in few) == {0: 4, 2: 4, 4: 4}
    assert neighbours.nearest(vectors.where("false"), F.col("vec_id") % 2 == 0).count() == 0


def test_chi_square():
    # Quantiles of 8 degrees.
    for p, x in ((0.5, 7.344), (0.95, 15.507), (0.99, 20.090)):
        assert abs(neighbours.chi_square_limit(p, 8) - x) < 1e-3


def test_empty_tables(spark):
    none = awkward(spark).where("false")
    for run in (packing.pack_documents, substrings.remove_repeated_windows, suffixes.remove_repeated_bytes, minhash.near_duplicates, minhash.distinct_documents, lines.remove_repeated_lines, mixing.mix_documents, mixing.sampled_documents, statistics.count_documents):
        assert run(none).count() == 0, run.__name__
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.apply_rules(none, labels).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, note = compare(QUERIES[name], ORACLE[name], spark, connect(SF), SF)
    assert ok and "types differ" not in note, note


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digest(spark):
    assert spark.createDataFrame([("é",)], "t string").select(substrings.digest("t")).first()[0] == digest("é")
