"""Each stage of the corpus pipeline against a plain version on its own input."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import lines, mixing, packing, quality, tables
from tests.llm.test_text import plain_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, by its name; the input comes first."""
    docs = tables.table(tables.prepared(spark), SF, "documents")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.written(stage(spark, docs, SF), name)
        out[name] = docs
    return {k: v.toPandas() for k, v in out.items()}


def test_columns_and_order(stages):
    assert list(stages) == ["input", "quality", "lines", "near_duplicates", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert list(stages[name].columns) == corpus_pipeline.COLUMNS
        assert len(stages[name]) > 50 or name == "mixing"
    for before, after in zip(list(stages)[:-2], list(stages)[1:-1]):
        assert len(stages[after]) < len(stages[before])


def test_quality_stage_keeps_what_the_classifier_accepts(spark, stages):
    labels = tables.table(spark, SF, "labels").where(quality.fold("doc_id", 4) != 2)
    scored = quality.classify(tables.table(spark, SF, "documents"), labels.selectExpr("doc_id", "quality AS label")).toPandas()
    assert set(stages["quality"].doc_id) == set(scored[scored.predicted == 1].doc_id)
    known = tables.table(spark, SF, "labels").toPandas()
    good = set(known[known.quality == 1].doc_id)
    assert len(good & set(stages["quality"].doc_id)) >= 0.97 * len(good)


def test_lines_stage(stages):
    """One edit apart: two lines that agree without a character at one place, or one that is the other without a character. Shorter
    lines with a word go by equality."""
    before, seen, want = stages["quality"].sort_values("doc_id"), set(), {}
    for r in before.itertuples():
        kept = []
        for line in r.text.split("\n"):
            if len(line) < lines.LEAST:
                if not line.strip(" \t\n\v\f\r") or ("short", line) not in seen:
                    kept.append(line)
                seen.add(("short", line))
                continue
            without = [line[:k] + line[k + 1 :] for k in range(len(line))]
            near = line in seen or any((k, v) in seen or v in seen for k, v in enumerate(without)) or ("longer", line) in seen
            if not near:
                kept.append(line)
            seen.add(line)
            seen.update(enumerate(without))
            seen.update(("longer", v) for v in without)
        want[r.doc_id] = "\n".join(kept)
    got = dict(zip(stages["lines"].doc_id, stages["lines"].text))
    given = dict(zip(before.doc_id, before.text))
    assert got == {i: t for i, t in want.items() if t == given[i] or t.strip() and corpus_pipeline.REMNANT * len(t) >= len(given[i])}
    assert (stages["lines"].n_chars == stages["lines"].text.str.len()).all()


def test_no_shred_of_a_near_copy_stays(spark):
    """Of 71 near copies of sf0.01 at 0.8, 24 stayed as a few characters each when only empty documents went."""
    sf = "/root/testdata/sf0.01"
    docs = tables.written(corpus_pipeline.quality_stage(spark, tables.table(spark, sf, "documents"), sf), "quality")
    rows = docs.select("doc_id", "text").toPandas()
    copies = {i for i, (_, _, kept) in plain_classes(list(zip(rows.doc_id, rows.text)), 80).items() if not kept}
    size = dict(zip(rows.doc_id, rows.text.str.len()))
    left = corpus_pipeline.lines_stage(spark, docs, sf).toPandas()
    assert len(copies) > 50
    assert all(corpus_pipeline.REMNANT * len(t) >= size[i] for i, t in zip(left.doc_id, left.text))
    kept = tables.written(corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(left), sf), "kept").toPandas()
    shreds = [i for i, t in zip(kept.doc_id, kept.text) if i in copies and corpus_pipeline.REMNANT * len(t) < size[i]]
    assert not shreds


def test_stages_of_awkward_tables(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", None, "a", None), (3, "one line of some words\n" * 3, "en", "a", 66), (3, "one line of some words\n" * 3, "en", "a", 66), (None, "x", "de", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "m") for r in rows], schema + ", __gone int, _key int, __drop int, `meta.url` string")
    for given in (docs, docs.where("false")):
        n = given.count()
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, given, SF)
            assert name == "packing" or found.columns == corpus_pipeline.COLUMNS
            assert found.count() <= n if name != "packing" else n == 0 or found.count() >= 1


def test_near_duplicate_stage(stages):
    before = stages["lines"]
    want = {i for i, (_, _, kept) in plain_classes(list(zip(before.doc_id, before.text))).items() if kept}
    assert set(stages["near_duplicates"].doc_id) == want
    assert dict(zip(stages["near_duplicates"].doc_id, stages["near_duplicates"].text)).items() <= dict(zip(before.doc_id, before.text)).items()


def test_near_duplicate_stage_links_from_four_fifths_on(spark):
    """Copies of similarity 0.80 to 0.85 go; those below stay."""
    docs, want = [], set()
    for k, cut in enumerate((20, 22, 25, 26, 40)):
        base = [f"w{k}x{i}" for i in range(229)]  # 225 shingles, of which a copy without its last words in common has ``cut`` others
        copy = base[: 229 - cut] + [f"other{k}x{i}" for i in range(cut)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} | ({2 * k + 1} if 100 * (225 - cut) < 80 * (225 + cut) else set())
    assert want == {0, 2, 4, 6, 7, 8, 9} and all(100 * (225 - cut) < 85 * (225 + cut) for cut in (20, 22, 25))
    rows = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, rows, SF).collect()} == want


def test_mixing_stage(spark, stages):
    topics = dict(tables.table(spark, SF, "embeddings").select("vec_id", "label").collect())
    rows = [(r.doc_id, (r.source, r.lang, topics.get(r.doc_id, -1)), len(r.text.split())) for r in stages["near_duplicates"].itertuples()]
    tokens = Counter()
    for _, cell, n in rows:
        tokens[cell] += n
    total, weight = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    goals = []
    for m in range(3):
        by = Counter()
        for cell, n in tokens.items():
            by[cell[m]] += n
        scale = sum(n**mixing.TEMPERATURE for n in by.values())
        goals.append({v: total * n**mixing.TEMPERATURE / scale for v, n in by.items()})
    for k in range(1, mixing.MOST_ROUNDS + 1):
        off = 0.0
        for m in range(3):
            sums = Counter()
            for cell, w in weight.items():
                sums[cell[m]] += w
            off = max(off, max(abs(goals[m][v] / n - 1) for v, n in sums.items()))
            weight = {c: w * goals[m][c[m]] / sums[c[m]] for c, w in weight.items()}
        if k % mixing.ROUNDS == 0 and off <= mixing.TOLERANCE:
            break
    budget = min(mixing.BUDGET, min(tokens[c] / w for c, w in weight.items()))
    import hashlib

    want = {i for i, c, _ in rows if int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 16**13 < round(min(1, budget * weight[c] / tokens[c]), 9)}
    assert set(stages["mixing"].doc_id) == want


def test_packing_stage(stages):
    encode = packing.Encoder(packing.default_vocabulary()).ids
    pieces = defaultdict(list)
    for r in stages["packing"].itertuples():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4")))
    assert set(pieces) == set(stages["mixing"].doc_id)
    for r in stages["mixing"].itertuples():
        assert np.concatenate([p for _, p in sorted(pieces[r.doc_id], key=lambda p: p[0])]).tolist() == [*encode(r.text).tolist(), 0]
    fill = stages["packing"].groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and (1024 - fill).sum() < 1024


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").toPandas()
    want = stages["packing"][["doc_id", "start", "length", "ids_crc32"]]
    assert Counter(map(tuple, rows.to_numpy().tolist())) == Counter(map(tuple, want.to_numpy().tolist()))
