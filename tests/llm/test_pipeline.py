"""The pipeline, stage by stage, on documents with planted cases."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from factorloom.llm import pii, quality_classifier, simhash, tagger
from factorloom.llm.common import TextEncoder, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_what_they_should(spark, docs, tmp_path):
    words = ["".join(random.Random(i).choices("etaoinsrhl", k=random.Random(-i).randint(2, 9))) for i in range(400)]
    text = lambda seed, n=120: " ".join(random.Random(seed).choices(words, k=n))
    item = text(5000, 40)
    rows = [(i, text(i)) for i in range(200)]
    rows += [(300 + i, " ".join(w + "!!" for w in text(9000 + i).split())) for i in range(40)]  # junk
    rows += [(400, text(3)), (401, text(3)), (500, text(600, 60) + " " + item + " " + text(601, 60)), (600, text(700) + " bob.x@mail2.example.com " + text(701)), (700, None), (701, ""), (None, text(800)), (5, text(5))]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(300 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        path = str(tmp_path / f"stage{k}")
        at.write.parquet(path)
        at = spark.read.parquet(path)
        if k < 4:
            assert at.columns == COLUMNS
        kept[name] = at.collect()
    first, second, third, fourth, last = kept.values()
    ids = lambda part: [r.doc_id for r in part]
    assert set(range(200)) <= set(ids(first)) and not {300 + i for i in range(40)} & set(ids(first)) and not {700, 701} & set(ids(first))
    prints = defaultdict(list)
    for r in first:
        prints[simhash.fingerprint((r.text or "").encode())].append(r)
    assert len(second) == len(prints) and not {400, 401} & set(ids(second)) and ids(second).count(5) == 1
    assert set(ids(second)) - set(ids(third)) == {500}
    assert "[EMAIL]" in next(r.text for r in fourth if r.doc_id == 600) and all(r.n_chars == len(r.text) for r in fourth)
    enc = TextEncoder(tokenizer_path()).tokenizer
    want = sum(len(enc.encode(r.text, add_special_tokens=False).ids) + 1 for r in fourth)
    assert sum(r.length for r in last) == want
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in again) == want
    assert np.all([0 < r.length <= 2048 for r in last])


def test_near_dedup_keeps_one_row_of_each_group(spark, docs, tmp_path):
    words = ["".join(random.Random(i).choices("etaoinsrhl", k=random.Random(-i).randint(2, 9))) for i in range(400)]
    text = lambda seed: " ".join(random.Random(seed).choices(words, k=120))
    rows = [(None, text(i)) for i in range(50)] + [(100 + i, text(i)) for i in range(0, 50, 2)]  # without id, half with a copy
    rows += [(5, text(500)), (5, text(501)), (7, text(501)), (9, text(502)), (8, text(502)), (8, text(502)), (3, None)]
    got = corpus_pipeline.near_dedup(spark, docs(rows, extra=True), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, text(i)) for i in range(50)] + [(5, text(500)), (5, text(501)), (8, text(502)), (3, "")])
    assert all(r.words == "x" for r in got)


# --- a twin in plain Python -----------------------------------------------------------------------


def twin_classify(rows, labels):
    """Rows (doc_id, text) whose noisy log weight is among the k largest; grams are counted whole."""
    grams = lambda t: (w := re.findall(r"[0-9a-z]+|[^0-9a-z\s]+", (t or "").lower()), list(zip(w, w[1:])))
    good = np.array(sorted(i for i, q, t in labels if q == 1 and not t))
    fits = set(good[quality_classifier.mix(quality_classifier.mix(good.astype(np.uint64))) & np.uint64(1) == 0].tolist())
    raw, own = ([defaultdict(int), defaultdict(int)] for _ in range(2))
    for i, t in rows:
        for n in (0, 1):
            for g in grams(t)[n]:
                raw[n][g] += 1
                own[n][g] += i in fits

    def weight(t):
        total = 0.0
        for n, z in ((0, 1.0), (1, 2.0)):
            share = sum(own[n].values()) / sum(raw[n].values())
            for g in grams(t)[n]:
                x, e = own[n][g] + 1, raw[n][g] * share + 1
                total += np.sign(np.log(x / e)) * max(0, abs(np.log(x / e)) - z * (1 / x + 1 / e) ** 0.5)
        return total

    scored = [(weight(t), i, t) for i, t in rows if (t or "").split()]
    held_out = np.sort([w for w, i, _ in scored if i in set(good.tolist()) - fits])
    bad = np.sort([w for w, i, _ in scored if i in {i for i, q, t in labels if q != 1 or t}])
    k = sum(w >= quality_classifier._threshold(held_out, bad, 0.002, 4.0) for w, _, _ in scored)
    hashed = [quality_classifier.mix(np.array([i], np.int64).view(np.uint64) + np.uint64(7)) if i is not None else np.array([7], np.uint64) for _, i, _ in scored]
    noise = [-np.log(-np.log(((int(quality_classifier.mix(h)[0]) >> 11) + 0.5) / 2**53)) for h in hashed]
    keys = sorted(((w + n, i, t) for (w, i, t), n in zip(scored, noise)), key=lambda x: -x[0])
    return [(i, t) for _, i, t in keys[:k]]


def twin_near_dedup(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    prints, kept = [simhash.fingerprint((t or "").encode()) for _, t in rows], []
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    seen = set()
    for r, g in zip(rows, group):
        if g not in seen:
            kept.append(r)
        seen.add(g)
    return kept


def twin_drop_leaks(rows, items):
    """Items here have neither capitals nor numbers: windows of five words, 80 % of them in one document."""
    windows = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)}
    return [r for r in rows if not any(len(windows(x) & windows(r[1])) >= 0.8 * len(windows(x)) for x in items)]


def twin_redact(rows):
    finder, out = pii.Finder(tagger.train()), []
    for i, t in rows:
        base = pii.base_spans(t or "")
        for start, end, kind in sorted(((s, e, k) for k, s, e in base + finder.added([t or ""], [base])[0]), reverse=True):
            t = t[:start] + f"[{pii.KINDS[kind].upper()}]" + t[end:]
        out.append((i, t))
    return out


def test_stages_equal_their_twins(spark, docs, tmp_path):
    words = ["".join(random.Random(i).choices("etaoinsrhl", k=random.Random(-i).randint(2, 9))) for i in range(300)]
    text = lambda seed, n=100: " ".join(random.Random(seed).choices(words, k=n))
    items = [text(5000, 40), text(5001, 30)]
    rows = [(i, text(i, 20 + i)) for i in range(120)] + [(200 + i, "win cash now !!! " * 20 + text(i, 20)) for i in range(30)]
    rows += [(None, text(800)), (None, text(801)), (5, text(900)), (7, text(0, 20)), (8, None), (9, " "), (300, text(1, 21) + " x"), (301, text(50) + " " + items[0] + " " + text(51))]
    rows += [(302, text(52) + " " + " ".join(items[1].split()[:-2])), (303, text(53) + " call 605-555-9305 or bob [at] mail [dot] example [dot] org, 10.1.2.3 " + text(54)), (304, text(55) + " mail bob.x@mail2.example.com " + text(56))]
    table = docs(rows, extra=True).withColumn("row", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("key", F.lit("k"))
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 30, 2)]
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    twins = [lambda r: twin_classify(r, labels), twin_near_dedup, lambda r: twin_drop_leaks(r, items), twin_redact]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, before = at.columns, rows
    for k, ((name, stage), twin) in enumerate(zip(corpus_pipeline.STAGES, twins)):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns
        at.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        got = order((r.doc_id, r.text) for r in at.collect())
        assert got == order(twin(before)), name
        before = got
    assert {r[0] for r in before} >= {303, 304} and not {r[0] for r in before} & {200, 301, 302}
    enc, pieces = TextEncoder(tokenizer_path()).tokenizer, defaultdict(list)
    for r in corpus_pipeline.pack(spark, at, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    for i, t in before:
        if i is not None:
            ids, upto = np.array(enc.encode(t, add_special_tokens=False).ids + [1], "<u4"), 0
            for r in sorted((r for r in pieces[i] if r.doc_tokens == len(ids)), key=lambda r: r.start):
                assert (r.start, r.ids_crc32) == (upto, zlib.crc32(ids[upto : upto + r.length]))
                upto += r.length
            assert upto == len(ids)


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
