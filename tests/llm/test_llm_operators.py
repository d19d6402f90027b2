"""The operators against brute force, exact round trips and held-out accuracy, with the odd cases each contract names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import chat_format, decontaminate, license_scan, packing, pii, quality_classifier, quality_rules, rans, simhash, suffix_dedup, tagger, token_output
from factorloom.llm.common import TextEncoder, shared_dir, tokenizer_path

rng = random.Random(5)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinsrhldcu") for _ in range(r.randint(1, 9))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "a b"), (5, prose(40, 1)), (5, prose(40, 1)), (6, "é" * 300 + " x"), (7, "x" * 50_000), (8, "a b " * 9000)]


# --- suffix dedup ---------------------------------------------------------------------------------


def brute_repeats(rows, length):
    counts = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        mark = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                mark[k] += 1
                mark[k + length] -= 1
        gone = mark.cumsum()[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_match_brute_force(docs, hot):
    passage, other = prose(80, 3), prose(60, 4)
    rows = [(i, prose(30 + i, 100 + i) + " " + passage[: 200 + 9 * i] + " " + prose(20, 200 + i)) for i in range(12)]
    rows += [(20, other), (21, other), (22, other[7:260]), (23, "ab" * 400), (24, prose(50, 9) + other[10:230]), (25, passage[3:203]), (26, passage[3:202])]
    rows += [(i, t) for i, t in ODD if t is None or len(t) < 3000]
    got = suffix_dedup.remove_repeats(docs(rows, extra=True), hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_rows_that_share_a_number_are_told_apart(spark):
    rows = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 1, "a"), (8, 3, "c"), (7, None, "b")], "uid long, doc_id long, text string")
    got = suffix_dedup._told_apart(rows).collect()
    assert len(got) == 5 and len({r.uid for r in got}) == 4 and len({r.uid for r in got if r.doc_id == 1}) == 1 and [r.uid for r in got if r.doc_id == 3] == [8]


def test_repeats_of_an_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs([])).collect() == []


def test_corpus_order_is_the_suffix_order():
    texts = [prose(30, 1), prose(30, 1)[5:90], "aaaaaaaaaaaaaaaaaaaaaaaa", prose(12, 2), prose(30, 1)[:50]]
    data = "".join(texts).encode()
    ends = np.array([len(t) for t in texts]).cumsum()
    begins = ends - np.array([len(t) for t in texts])
    starts = np.concatenate([np.arange(a, b - 8) for a, b in zip(begins, ends)])
    order = suffix_dedup.corpus_order(data, begins, ends, starts, bits=2)
    end = {int(s): int(ends[np.searchsorted(ends, s, "right")]) for s in starts}
    suffixes = [data[s : end[s]] for s in starts[order].tolist()]
    assert suffixes == sorted(suffixes)


# --- license scan ---------------------------------------------------------------------------------


def test_license_base_matches_brute_force(docs):
    rows = [(10, "Released under the MIT License. mit-license MIT  LICENSE"), (11, "gnu general public license, apache license; cc by cc by"), (12, "mit licenses xmit license mit éa license")] + ODD
    got = {}
    for r in license_scan.license_scan(docs(rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t in dict(rows).items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_notices_with_edits(docs):
    rows = [(1, prose(30, 1) + " Licensd undr the Apache License " + prose(9, 2)), (2, "GNU Generel Publik License"), (3, prose(400, 5)), (4, "the apache helicopter licence fee")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(rows)).collect()}
    assert got[1].labels == "apache" and got[2].labels == "gpl" and got[2].base_labels == "" and 0.8 < got[2].score < 1
    assert got[3].labels == got[4].labels == "" and got[3].score == 0
    assert (got[2].spans[0].start_word, got[2].spans[0].end_word) == (0, 3)
    assert license_scan.license_scan(docs([])).collect() == []
    assert [r.labels for r in license_scan.license_scan(docs(rows, extra=True)).collect()] == [got[i].labels for i, _ in rows]
    many = license_scan.license_scan(docs([(1, "the mit license " * 30_000)])).first()
    assert (many.n_base, many.first_word, many.last_word) == (30_000, 1, 89_998)


def test_every_notice_within_its_edits_is_found():
    r = random.Random(8)
    notices = [license_scan.Notice(*x) for x in license_scan.NOTICES]
    for notice in notices:
        for _ in range(40):
            text = list(notice.text.decode())
            for _ in range(r.randint(0, notice.edits)):
                at = r.randrange(1, len(text) - 1)
                kind = r.randrange(3)
                text[at : at + (kind != 0)] = [] if kind == 1 else [r.choice("etaoinsrhl")]
            found = license_scan.scan((prose(20, r.random()) + " " + "".join(text) + " " + prose(20, r.random())).encode(), [], [notice])
            assert found["labels"] == notice.label and found["spans"]


# --- chat format ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|", "a<|", None, "", "<|nl|>", "\n\n"]
    rows = [(c, k, role, t) for c, role in ((1, "assistant"), (2, "user\nx"), (3, "<|nl|>"), (4, None)) for k, t in enumerate(texts)]
    rows += [(5, 0, "user", "hi"), (5, 0, "user", "hi"), (None, 0, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat_format.probe(spark))
    turns = chat_format.format_turns(table)
    by_conv = defaultdict(str)
    for r in turns.collect():
        by_conv[r.conv_id] += r.rendered
    for conv in (1, 2, 3, 4, 5, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert chat_format.parse(by_conv[conv]) == want
    got = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    one = [t or "" for t in texts]
    assert got[1].n_turns == len(texts) and got[1].loss_chars == sum(map(len, one)) and got[1].formatted_chars == len(by_conv[1])
    assert got[1].loss_sha256 == hashlib.sha256("".join(one).encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"assistant\n{t}\n" for t in one).encode()).hexdigest()
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 34
    assert chat_format.digests(chat_format.format_turns(table.limit(0))).collect() == []
    shuffled = chat_format.digests(turns.orderBy(F.xxhash64("rendered"))).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got.values())) == sorted(map(str, chat_format.digests(turns, in_order=True).collect()))
    with pytest.raises(Exception, match="out of place"):
        chat_format.digests(turns.coalesce(1).sortWithinPartitions(F.desc("turn_no")), in_order=True).collect()
    clash = table.withColumn("turn_no", F.lit(1)).withColumn("rendered", F.lit("x")).withColumn("assistant", F.lit("y"))
    assert sorted(map(str, chat_format.digests(chat_format.format_turns(clash)).collect())) == sorted(map(str, got.values()))
    long = "<|im_end|>" * 100_000
    one = spark.createDataFrame([(1, 0, "assistant", long)], table.schema)
    assert chat_format.digests(chat_format.format_turns(one)).first().loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


# --- pii ------------------------------------------------------------------------------------------


def test_pii_base_matches_patterns():
    def brute(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and tagger.luhn(d):
                out.append((2, *m.span()))
        return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    for _ in range(4000):
        t = "".join(rng.choice("aA1.@@+-_% ()é9") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t)


def test_tagger_on_held_out_sentences():
    make, weights = tagger.Generator(991), tagger.train()
    pairs = [make.sentence(96) for _ in range(200)]
    codes, gold = np.stack([tagger.classes(t) for t, _ in pairs], 1), np.stack([y for _, y in pairs], 1)
    assert (tagger.decode(tagger.emissions(codes, weights), weights) == gold).mean() > 0.97


def test_tagger_finds_what_the_patterns_miss():
    make, finder = tagger.Generator(5), pii.Finder(tagger.train())
    texts, spans = [], []
    for i in range(1600):
        part, before = getattr(make, tagger.KINDS[i % 4])(), " ".join(make.word() for _ in range(12)) + " "
        texts.append(before + part + " " + " ".join(make.word() for _ in range(12)))
        spans.append((i % 4, len(before), len(before) + len(part)))
    base = [pii.base_spans(t) for t in texts]
    missed, found = Counter(), Counter()
    for span, own, added in zip(spans, base, finder.added(texts, base)):
        if not any(s < span[2] and span[1] < e for _, s, e in own):
            missed[span[0]] += 1
            found[span[0]] += span in added
    assert all(missed[k] > 100 and found[k] >= 0.9 * missed[k] for k in range(4))
    clean = [prose(60, i) + f" {i} of 12.5 at 10:30 on 2024-05-{i % 28 + 1} " + prose(40, i + 500) for i in range(300)]
    assert sum(map(len, finder.added(clean, [[] for _ in clean]))) == 0


def test_pii_of_very_long_runs(docs):
    rows = [(1, "1.2.3." + "9" * 6000), (2, "7" * 300_000 + " x"), (3, "0" * 5000 + "1.0.0.1"), (4, "a" * 300_000 + "@"), (5, "+" * 100_000 + "1" * 50), (6, "1 " * 100_000), (7, "1.2.3.4 " * 20_000)]
    got = {r.doc_id: r for r in pii.find(docs(rows)).collect()}
    assert [got[i].n_ip for i in (1, 2, 3, 7)] == [0, 0, 1, 20_000]


def test_windows_tile_the_text():
    """Where a span is wherever it lies, the window that decides it sees all of it, so a shift of the text shifts the spans."""
    finder, piece = pii.Finder(tagger.train()), "605-555-9305"
    texts = ["e" * 7 + " " + "ab cd " * 20 + ("loru is te mona " * 7)[:shift] + " " + piece + " " + "ef gh " * 30 for shift in range(100)]
    added = finder.added(texts, [[] for _ in texts])
    assert sum([(k, t[s:e]) for k, s, e in a] == [(3, piece)] for t, a in zip(texts, added)) >= 97


def test_pii_finds_and_redacts(docs):
    rows = [(10, "call +1 (605) 555-9305 4078918989542222 now"), (11, "mail bob.x@mail2.example.com at 10.0.0.7 or 999.1.1.1"), (12, "version 2.0 costs 30 or 4.5")] + ODD
    got = defaultdict(list)
    for r in pii.find(docs(rows)).collect():
        got[r.doc_id].append(r)
    assert got[10][0].spans == "card:23:39,phone:5:22" and got[10][0].n_card == 0
    assert got[11][0].spans == "email:5:28,ip:32:40" and got[12][0].spans == ""
    assert len(got[4]) == 2 and got[1][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[11][0].base_sha256 == hashlib.sha256(b"email:5:28,ip:32:40").hexdigest()
    clean = {r.doc_id: r for r in pii.redact(docs(rows, extra=True)).collect()}
    assert clean[10].text == "call [PHONE] [CARD] now" and clean[10].n_chars == len(clean[10].text) and clean[1].text is None and clean[10].words == "x"
    assert pii.find(docs([])).collect() == []


# --- decontamination ------------------------------------------------------------------------------


def test_decontamination(spark, docs):
    question = "a train leaves the old station with 45 passengers and then Maria boards it carrying 12 kg of apples for the market"
    other = question.replace("45", "61").replace("Maria", "Lena").replace("12 kg", "30 lbs")
    mixed = question.replace("45", "12").replace("12 kg", "45 kg") + " . " + question.replace("45", "77")
    bench = spark.createDataFrame([(0, question), (1, prose(40, 77)), (2, "too short"), (3, None)], "item_id long, text string")
    rows = [(10, prose(50, 1) + ". " + question + ". " + prose(50, 2)), (11, prose(9, 3) + " , " + other + " " + prose(50, 4)), (12, prose(300, 5)), (13, question[:60]), (14, prose(40, 77).upper())] + ODD
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(rows, extra=True), bench).collect()}
    assert {i for i, r in got.items() if r.leaked} == {10, 11, 14}
    assert got[10].item_ids == "0" and got[14].item_ids == "1" and got[12].coverage == 0
    assert len(decontaminate.decontaminate(docs(rows), bench).collect()) == len(rows)
    assert not any(r.leaked for r in decontaminate.decontaminate(docs(rows), bench.limit(0)).collect())
    assert decontaminate.decontaminate(docs([]), bench).collect() == []
    assert {r.doc_id for r in decontaminate.matches(docs([(1, mixed)]), bench).collect()} <= {1}


def test_leaks_are_judged_by_alignment(spark, docs):
    trains = "A train travels 60 km in 2 hours and a second train travels 90 km in 3 hours and a third train travels 75 km in 5 hours without any stop at all"
    pens = "the shop sold 48 pens in april and then half as many in may so how many of them were sold altogether by the shop"
    bench = spark.createDataFrame([(0, trains), (1, pens)], "item_id long, text string")
    changed, longer = pens.replace("48", "96"), pens.replace("then half", "then only half")
    rows = [(1, trains), (2, pens + ". " + changed), (3, changed + ". " + prose(30, 1) + " " + pens.replace("48", "31")), (4, longer + ". " + changed), (5, pens[:50]), (6, prose(60, 2))]
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs(rows), bench).collect()}
    assert got == {1: "0", 2: "1", 3: "1", 4: "1", 5: "", 6: ""}


def test_leaks_in_other_letters_names_units_and_short_items(spark, docs):
    shop = "In the shop Tom bought 3 pens for 4 dollars and Anna bought 5 books for 9 dollars. How much did they pay in all?"
    miles = "Otto drove 60 miles on monday and then 75 miles on the next day before he came home to rest"
    items = [(0, shop), (1, miles), (2, "Gruß Welt"), (3, "4 8 15 16 23 42"), (4, ""), (5, "Bonjour"), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, shop.lower()), (2, shop.upper()), (3, shop.replace("Tom", "Ulla").replace("Anna", "Ben").replace("3 pens", "8 pens")), (4, miles.replace("Otto", "Maria").replace("miles", "km")),
        (5, "sie sagt gruß welt und geht"), (6, "4 8 15 16 23 42"), (7, "4 8 15 16 23 41"), (8, "welt gruß"), (9, prose(60, 4)), (10, "..."), (11, miles.replace("60 miles", "60 kg").replace("75", "60")),
    ]
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs(rows, extra=True), bench).collect()}
    assert got == {1: "0", 2: "0", 3: "0", 4: "1", 5: "2", 6: "3", 7: "", 8: "", 9: "", 10: "", 11: "1"}


def test_new_parameters_are_seen_through(spark, docs):
    r = random.Random(9)
    names, units = ["Tom", "Anna", "Maria", "Otto", "Lena", "Ulla"], ["kg", "km", "hours", "dollars", "miles"]

    def fill(frame):
        own = r.sample(names, 2)
        return " ".join(own[int(w[1])] if w[0] == "N" else str(r.randint(2, 99)) if w == "#" else r.choice(units) if w == "U" else w for w in frame)

    frames = []
    for k in range(40):
        words = prose(r.randint(14, 30), 4000 + k).split()
        for w in ("N0", "N1", "#", "#", "# U", "N0"):
            words.insert(r.randrange(len(words)), w)
        frames.append(" ".join(words).split())
    items = [(k, fill(f)) for k, f in enumerate(frames)]
    rows = [(k, prose(30, k) + ". " + fill(f) + ". " + prose(30, k + 50)) for k, f in enumerate(frames)] + [(100 + k, prose(90, 9000 + k)) for k in range(40)]
    got = {x.doc_id: x.item_ids for x in decontaminate.decontaminate(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum(got[k] == str(k) for k in range(40)) >= 36 and not any(got[100 + k] for k in range(40))


def test_leaks_of_null_and_repeated_ids(spark, docs, tmp_path):
    import corpus_pipeline

    item, clean = prose(40, 77), prose(50, 78)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(None, item + " x"), (None, clean), (7, item), (7, clean), (8, clean), (None, None)]
    got = decontaminate.decontaminate(docs(rows), bench).collect()
    assert Counter((r.doc_id, r.leaked) for r in got) == Counter({(None, True): 1, (None, False): 2, (7, True): 1, (7, False): 1, (8, False): 1})
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.drop_leaks(spark, docs(rows), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, clean), (7, clean), (8, clean), (None, None)])


# --- packing --------------------------------------------------------------------------------------


def test_fill_is_the_best_subset_sum():
    for _ in range(200):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 9)))
        room = rng.randint(0, 90)
        sums = {0}
        for x, n in counts.items():
            sums |= {s + x * k for s in sums for k in range(n + 1)}
        picked = packing.fill(sorted(counts, reverse=True), counts, room)
        assert sum(x * n for x, n in picked) == max(s for s in sums if s <= room) and all(n <= counts[x] for x, n in picked)


@pytest.mark.parametrize("lengths", [[1500] * 50, [1200, 900] * 30, [3] * 999, [2048, 4096, 1], [1]])
def test_windows_are_full(lengths):
    packer, upto = packing.Packer(2048, 64), defaultdict(int)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype=np.uint32))
    packer.finish()
    sizes = defaultdict(int)
    for doc, start, n, _, total, sequence, offset in sorted(packer.out, key=lambda x: (x[0], x[1])):
        assert start == upto[doc] and total == lengths[doc]
        upto[doc] += n
        sizes[sequence] += n
    assert dict(upto) == dict(enumerate(lengths)) and sum(packer.shares) == sum(lengths)
    assert sum(x != 2048 for x in sizes.values()) <= 11 and all(x & (x - 1) == 0 for x in sizes.values())


@pytest.mark.parametrize("chunk", [16, 2048])
def test_packing(docs, chunk):
    rows = [(1000 + i, prose(int(3 ** rng.uniform(0, 7)), i)) for i in range(60)] + ODD
    out = packing.pack(docs(rows, extra=True), tokenizer_path(), chunk=chunk).collect()
    assert packing.pack(docs([]), tokenizer_path()).collect() == []
    enc = TextEncoder(tokenizer_path())
    pieces, sequences, want = defaultdict(list), defaultdict(list), Counter()
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        want[i] += len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: sum(r.length for r in x) for i, x in pieces.items()} == dict(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for i, t in ((i, t) for i, t in rows if sum(i == x for x, _ in rows) == 1):
        ids, at = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            at += r.length
    one = [r for r in out if r.doc_id == 7]
    ids = np.array(enc.tokenizer.encode("x" * 50_000, add_special_tokens=False).ids + [1], "<u4")
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids) for r in one)


# --- quality rules --------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(docs):
    rows = [(100 + i, prose(60 + i, i)) for i in range(60)] + [(200, "\n".join(["same line here"] * 9) + " # * |"), (201, ("###%% " * 40) + prose(30, 3)), (202, prose(12, 1) + " " + prose(12, 1))] + ODD
    got = defaultdict(list)
    for r in quality_rules.quality_rules(docs(rows, extra=True)).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        r = got[i][0]
        n, chars, symbols, lines, repeats = brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), i
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)
    assert all(got[100 + i][0].kept for i in range(60)) and not got[201][0].kept and len(got[4]) == 2
    assert quality_rules.quality_rules(docs([])).collect() == []
    bare = docs(rows[:5] + ODD[:3]).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert [(r.lang, r.source) for r in quality_rules.quality_rules(bare).collect()] == [("", "")] * 8
    assert all(r.kept for r in quality_rules.quality_rules(docs([(1, prose(50, 1)), (2, prose(60, 2))])).collect())


def test_masked_outliers_are_found(docs):
    """A third of all rows lie far off in one direction: mean and covariance alone would follow them."""
    rows = [(i, prose(80, i)) for i in range(140)] + [(500 + i, " ".join(w + "#$" for w in prose(80, 900 + i).split())) for i in range(45)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs(rows)).collect()}
    assert all(got[i] for i in range(140)) and not any(got[500 + i] for i in range(45))


def test_robust_distances_equal_a_numpy_twin(docs):
    rows = [(i, prose(40 + i % 50, i) + " #" * (i % 4) + (" zzzzzzzzzzzzzzzzzz" * 30 if i % 17 == 0 else "")) for i in range(150)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(rows)).collect()}
    x = []
    for _, t in rows:
        n, chars, symbols, dup, repeats = brute_statistics(t)
        lines = sum(1 for line in t.split("\n") if line.strip())
        x.append((np.log(chars / max(n, 1)), np.sqrt(symbols / max(chars, 1)), np.sqrt(dup / max(lines, 1)), np.sqrt(repeats / max(n, 1))))
    x = np.array(x)
    ok = np.array([not got[i].base_failed for i, _ in rows])

    def estimate(part, scale):
        return part.mean(0), scale * np.cov(part.T, bias=True) + np.diag(np.square(quality_rules.FLOORS))

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def middle(p):
        """The first bin whose counts reach the share p, for each column."""
        bins = np.sort(np.floor(x[ok] * quality_rules.BINS), axis=0)
        return (bins[int(np.ceil(p * len(bins))) - 1] + 0.5) / quality_rules.BINS

    spread = (middle(0.75) - middle(0.25)) / 1.349
    starts, before = [estimate(x[ok], 1.0), (middle(0.5), np.diag(spread**2 + np.square(quality_rules.FLOORS)))], None
    while True:
        for k, (mean, cov) in enumerate(starts):
            bins = np.floor(16 * np.log2(np.maximum(distances(mean, cov)[ok], 1e-9)))
            order = np.sort(bins)
            top = order[int(np.ceil(quality_rules.SHARE * len(order))) - 1]
            starts[k] = estimate(x[ok][bins <= top], quality_rules.CONSISTENCY)
        now = [(np.linalg.slogdet(cov)[1], k, mean, cov) for k, (mean, cov) in enumerate(starts)]
        if before is not None:
            if max(p[0] - q[0] for p, q in zip(before, now)) <= quality_rules.TOLERANCE:
                break
            now = [min(x, key=lambda e: e[0]) for x in zip(before, now)]
        before = now
    _, _, mean, cov = min(before, key=lambda e: e[:2])
    for d, fine, (i, _) in zip(distances(mean, cov), ok, rows):
        if fine:
            assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9) and got[i].kept == (d <= quality_rules.CUTOFF)
        else:
            assert got[i].distance is None and not got[i].kept


# --- quality classifier ---------------------------------------------------------------------------


def test_quality_classifier(spark, docs):
    def junk(n, seed):
        return " ".join(w + "!!" for w in prose(n, seed).split()[: n // 2]) + " buy now cheap " * (n // 4)

    vocabulary = prose(400, 12).split()
    rows = [(i, " ".join(random.Random(i).choices(vocabulary, k=150))) for i in range(300)] + [(1000 + i, junk(150, i)) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    more = rows + [(-1, None), (-2, " "), (None, rows[0][1])]
    for r in quality_classifier.classify(docs(more, extra=True), labels).collect():
        got[r.doc_id].append(r)
    assert sum(got[i][0].selected for i in range(300)) >= 298 and sum(got[1000 + i][0].selected for i in range(100)) <= 2
    assert not got[-1][0].selected and not got[-2][0].selected
    kept = quality_classifier.keep_selected(docs(more), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r[0].selected} and kept.columns[:2] == ["doc_id", "text"]
    assert quality_classifier.classify(docs([]), labels).collect() == []
    assert all(r.selected for r in quality_classifier.classify(docs(rows[:5]), labels.limit(0)).collect())


def brute_weights(rows, target, shrink):
    """Log weights by plain counting of whole grams, without buckets."""
    def grams(t):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\s\x80-\U0010ffff]+", t.lower(), re.A)
        return words, list(zip(words, words[1:]))

    raw, own = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        for n in (0, 1):
            raw[n].update(grams(t)[n])
            own[n].update(grams(t)[n] if i in target else ())
    total = [(sum(own[n].values()), sum(raw[n].values())) for n in (0, 1)]

    def ratio(n, g):
        expected = raw[n][g] * total[n][0] / total[n][1]
        x = np.log((own[n][g] + 1) / (expected + 1))
        return np.sign(x) * max(abs(x) - shrink[n] * np.sqrt(1 / (own[n][g] + 1) + 1 / (expected + 1)), 0)

    return {i: sum(ratio(n, g) for n in (0, 1) for g in grams(t)[n]) for i, t in rows}


def test_resampling_matches_brute_force(spark, docs):
    vocabulary = prose(300, 12).split()
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(vocabulary[:200], k=60)) + ".") for i in range(200)]
    rows += [(1000 + i, " ".join(r.choices(vocabulary[150:], k=r.randint(2, 60)))) for i in range(150)] + [(5000 + i, " ".join(r.choices(vocabulary, k=9)) + ", x!") for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000, 0, 0), (1, 1, 1), (1001, 1, 1)], "doc_id long, quality int, toxic int")
    good = np.arange(0, 200, 2)
    half = good[quality_classifier.mix(quality_classifier.mix(good.astype(np.uint64))) & np.uint64(1) == 0]
    want = brute_weights(rows, set(half.tolist()), (1.0, 2.0))
    got = {x.doc_id: x for x in quality_classifier.classify(docs(rows, extra=True), labels).collect()}
    close = sum(abs(got[i].log_weight - w) < 1e-3 for i, w in want.items())
    assert close >= 0.97 * len(rows)  # grams that share a bucket are rare here
    noise = {i: x.key - x.log_weight for i, x in got.items()}
    assert 0.3 < np.mean(list(noise.values())) < 0.9 and 1.0 < np.std(list(noise.values())) < 1.6
    for k in (1, 40, 399, 400):
        best = {x.doc_id for x in sorted(got.values(), key=lambda x: -x.key)[:k]}
        assert {x.doc_id for x in quality_classifier.classify(docs(rows), labels, k=k).collect() if x.selected} == best
        assert k > 300 or best != {x.doc_id for x in sorted(got.values(), key=lambda x: -x.log_weight)[:k]}


def test_few_toxic_words_are_enough(spark, docs):
    vocabulary = prose(400, 12).split()
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(20, 600)))) for i in range(600)]
    toxic = set(range(0, 600, 6))
    rows = [(i, t + " vile, awful rotten vile." if i in toxic else t) for i, t in rows]
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 600, 1 + 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.selected for x in quality_classifier.classify(docs(rows), labels).collect()}
    assert sum(got[i] for i in toxic) <= 5 and sum(not got[i] for i in range(600) if i not in toxic) <= 5


def test_cutoff_is_the_kth_key(spark):
    keys = [float(x) for x in np.random.default_rng(3).normal(0, 50, 500)] + [7.5] * 5
    scores = spark.createDataFrame([(i, 0.0, k) for i, k in enumerate(keys)], "doc_id long, log_weight double, key double")
    for k in (1, 7, 250, 505):
        least = quality_classifier.cutoff(scores, k)
        assert sorted(keys, reverse=True)[k - 1] - least < 1e-6 and least <= sorted(keys, reverse=True)[k - 1]
    assert quality_classifier.cutoff(scores, 0) == float("inf")


# --- token output ---------------------------------------------------------------------------------


def test_rans_round_trip_and_damage():
    import io

    r = np.random.default_rng(1)
    for n in (0, 1, 63, rans.BLOCK, rans.BLOCK + 7):
        ids = (r.zipf(1.3, n) % 49408).astype(np.uint32)
        blob = rans.encode_segment(np.array([7, 9]), np.array([n // 2, n - n // 2]), ids)
        assert (rans.read_segment(io.BytesIO(blob).read)[2] == ids).all()
    spoilt = bytearray(blob)
    spoilt[-9] ^= 1
    with pytest.raises(ValueError):
        rans.read_segment(io.BytesIO(bytes(spoilt)).read)


def test_single_blocks_from_their_checkpoints():
    r = np.random.default_rng(2)
    ids = (r.zipf(1.3, 3 * rans.BLOCK + 1000) % 49408).astype(np.uint32)
    blob = rans.encode_segment(np.array([1, 2]), np.array([5, len(ids) - 5]), ids)
    for which in ([3], [1], [2, 0]):
        for b, got in zip(which, rans.read_blocks(blob, which)):
            assert (got == ids[b * rans.BLOCK : (b + 1) * rans.BLOCK]).all()
    spoilt = bytearray(blob)
    spoilt[-3] ^= 1  # in the last block's words
    assert (rans.read_blocks(bytes(spoilt), [1])[0] == ids[rans.BLOCK : 2 * rans.BLOCK]).all()
    with pytest.raises(ValueError):
        rans.read_blocks(bytes(spoilt), [3])


def test_a_repeated_attempt_replaces_its_file(tmp_path):
    from pyarrow import fs

    class Strict:
        """A file system that does not rename onto a file, as some shared ones."""

        def __init__(self):
            self.real = fs.LocalFileSystem()

        def move(self, a, b):
            if self.real.get_file_info(b).type == fs.FileType.File:
                raise OSError("exists")
            self.real.move(a, b)

        def delete_file(self, a):
            self.real.delete_file(a)

    for text in ("one", "two"):
        (tmp_path / "t").write_text(text)
        token_output._put(Strict(), str(tmp_path / "t"), str(tmp_path / "f"))
    assert (tmp_path / "f").read_text() == "two"


def test_frequencies():
    for counts in ([1], [1, 10**9], [1] * 65536, [5] * 40000 + [10**8]):
        f = rans.frequencies(np.array(counts))
        assert f.sum() == 1 << 16 and f.min() >= 1


def test_token_output(spark, docs):
    rows = [(i, prose(50, i)) for i in range(40, 10, -1)] + [(99, "<|endoftext|> x <|ENDOFTEXT|>")] + ODD
    directory = shared_dir(spark) + "/ids"
    manifest = token_output.write(docs(rows, extra=True), directory, tokenizer_path()).collect()
    got = token_output.read(manifest, directory, spark).collect()
    enc, at, want = TextEncoder(tokenizer_path()).tokenizer, 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = token_output.write(docs([]), shared_dir(spark) + "/none", tokenizer_path()).collect()
    assert token_output.read(empty, directory, spark).collect() == []


# --- simhash --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    base = prose(300, 8)
    words = base.split()
    rows = [(50 + i, " ".join(words[:i] + ["zz"] + words[i + 1 :])) for i in range(0, 120, 3)] + [(900, base), (901, base.upper()), (902, "one two"), (903, "one two")] + ODD
    rows += [(300 + i, prose(40, i)) for i in range(30)]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                up = [up[a] if x == up[b] else x for x in up]
    least = {}
    for root, (i, _) in zip(up, prints):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted(((i, f, least[root]) for root, (i, f) in zip(up, prints)), key=str)
    for blocks, hot in ((4, 1 << 20), (5, 1 << 20), (4, 2)):
        got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs(rows, extra=True), blocks=blocks, hot=hot).collect()]
        assert sorted(got, key=str) == want
    assert simhash.simhash_components(docs([])).collect() == []


def test_links_of_crowded_fingerprints(spark):
    r = np.random.default_rng(4)
    seeds = r.integers(0, 1 << 62, 6)
    codes = sorted({int(x) ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for x in seeds for i, j, k in r.integers(0, 62, (60, 3))})
    table = spark.createDataFrame([(c,) for c in codes], "fp long")
    up = {c: c for c in codes}
    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= 3 and up[a] != up[b]:
                up = {c: up[a] if x == up[b] else x for c, x in up.items()}
    want = {frozenset(c for c in codes if up[c] == x) for x in set(up.values())}
    for hot in (1 << 20, 20):
        got = {c: c for c in codes}
        for e in simhash.links(table, hot=hot).collect():
            assert (up[e.a], e.a < e.b) == (up[e.b], True)
            got = {c: got[e.a] if x == got[e.b] else x for c, x in got.items()}
        assert {frozenset(c for c in codes if got[c] == x) for x in set(got.values())} == want


def test_trie_join_matches_all_pairs():
    r = np.random.default_rng(2)
    codes = np.unique(np.concatenate([r.integers(0, 1 << 63, 800, dtype=np.uint64), np.uint64(99) ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64))]))
    got = {p for i, j in simhash.trie_pairs(codes, 3, 0, most=500) for p in zip(i.tolist(), j.tolist())}
    apart = np.bitwise_count(codes[:, None] ^ codes[None])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= 3, 1)))))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 100)]
    table = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 200, 500]], "node long")
    got = {r.node: r.root for r in simhash.components(nodes, table).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 200: 100, 500: 500}


# --- tokenization ---------------------------------------------------------------------------------


def test_encoder_compares_bytes():
    enc = TextEncoder(tokenizer_path())
    enc.table = np.ones(256, np.uint64)
    enc.power = enc.inverse = np.ones(len(enc.power), np.uint64)  # a hash that tells only lengths apart
    texts = [prose(200, 1), "Abc abd ABC xyz " + "q" * 300 + " " + "r" * 300, prose(50, 2), "a", ""]
    for _ in range(2):
        ids, offsets = enc.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    enc = TextEncoder(tokenizer_path())
    texts = ["", "a\x1cb  c", "İSTANBUL ΣΑΣ", "<|endoftext|> <|ENDOFTEXT|>x", "it's DON'T we'll 12a3 ½ é ́a", "a b c\x85d\x0be", "ﬁ Ǆ ª º µ ÷ × ß ẞ", "don't. can't, 'S", "日本語 テスト。😀", "a,.b;É.x é, ÷, ×.,a …. a.́b", "  \n "]
    signs = [bin(i).count("1") % 2 for i in range(4096)]
    twins = ["".join("ab"[x ^ flip] for x in signs[:n]) for n in (64, 128, 1024, 2048, 4096) for flip in (0, 1)]
    for t in twins:  # complementary Thue-Morse words have equal polynomial hashes modulo 2**64
        assert TextEncoder(tokenizer_path()).encode([t.encode()])[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    for lot in (twins, ["x " + " y ".join(twins), *texts[:3]], twins[::-1], texts, [t for t in texts if "<|" not in t], [("Abc, de " * 700_000), "x"]):
        ids, offsets = enc.encode([t.encode() for t in lot])
        for k, t in enumerate(lot):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
