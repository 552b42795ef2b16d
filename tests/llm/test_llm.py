"""Each operator against brute force, an exact round trip or held-out accuracy; and the hard inputs that all must bear."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import avi, bpe, common, compact_windows, language_id, line_dedup, mixing, queries, repetition, rule_ensemble, simhash, token_counts

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, size int, row string"
random.seed(5)
HARD = [None, "", " \n\t ", "One", "é日本🎉 A\n\nB", "a" * 3000, "x y " * 900, "\n".join(["Same long line that stands in many of the documents here."] * 3), "Zürich ÀÉ ẞ", "#$% | <b>&amp;</b>"]


def hard(spark, copies: int = 1):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like those that operators add."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "e", 1, "r") for i, t in enumerate(HARD)]
    rows += [(None, None, None, None, None, None, None, None), (None, "no id here", "en", None, 3, None, None, None), (3, "One", "en", "s0", 3, "e", 1, "r"), (3, "One", "en", "s0", 3, "e", 1, "r")]
    return spark.createDataFrame(rows * copies, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in docs(spark).select("doc_id", "text").collect()}


ALL = {
    "avi": avi.round_trip,
    "bpe": queries.encode_documents,
    "windows": compact_windows.repeated_passages,
    "language": lambda d: language_id.identify(d, P.path("piece_bpe_32k.model")),
    "lines": line_dedup.report,
    "mixing": mixing.mix,
    "repetition": repetition.repetition,
    "simhash": simhash.near_dedup,
    "tokens": lambda d: token_counts.token_counts(d, P.path("byte_bpe_multi_50k.tiktoken")),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_hard_inputs(spark, name):
    d = hard(spark)
    got = ALL[name](d)
    rows = got.count()
    if name != "windows":
        assert rows == d.count()
    assert ALL[name](empty(spark)).count() == 0


def test_rule_ensemble_on_hard_inputs(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 0), (3, 0, 0), (3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = rule_ensemble.fit(hard(spark), some)
        got = rule_ensemble.score(hard(spark), model).collect()
        assert len(got) == hard(spark).count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert rule_ensemble.score(empty(spark), model).count() == 0


def test_language_is_found_in_held_out_texts(spark):
    got = language_id.identify(docs(spark), P.path("piece_bpe_32k.model")).join(docs(spark).select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    und = language_id.identify(hard(spark), P.path("piece_bpe_32k.model")).where("doc_id IN (0, 1, 2)").collect()
    assert {(r["lang_pred"], r["score"]) for r in und} == {("und", 0.0)}


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "bb"])
    p = np.array([[0.1], [0.2], [0.05], [0.07], [0.11], [0.13], [0.17], [1e-8]])
    table = dict(zip(["▁", "▁a", "a", "b", "ab", "▁ab", "bb"], p[:, 0]))

    def splits(s: str) -> float:
        return 1.0 if not s else sum((table.get(s[:k]) or (1e-8 if k == 1 else 0.0)) * splits(s[k:]) for k in range(1, len(s) + 1))

    for word in ("ab", "abb", "bcab", "a"):
        codes = np.array([[ord(c) for c in "▁" + word]], np.uint64)
        got = language_id.forward(pieces.lattice(codes), 1, codes.shape[1], p)[-1, 0, 0]
        assert got == pytest.approx(splits("▁" + word))
        assert language_id.log_long(pieces, codes[0], p)[0] == pytest.approx(np.log(got))


def test_long_words_teach_and_score_like_short_ones():
    pieces = language_id.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "bb", "é"])
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.05, 0.02], [0.07, 0.3], [0.11, 0.1], [0.13, 0.1], [0.17, 0.05], [0.1, 0.1], [1e-8, 1e-8]])
    word = "".join(random.choice("abé?") for _ in range(25))
    codes = np.array([ord(c) for c in "▁" + word], np.uint64)
    short = language_id.expected(pieces, [word], np.array([1]), np.array([3.0]), p)
    piece, share = language_id.expected_long(pieces, codes, p[:, 1])
    long = np.zeros(len(p))
    np.add.at(long, piece, 3 * share * language_id.SHARES)
    assert np.allclose(short[:, 1], long, atol=len(piece)) and not short[:, 0].any()
    assert np.isfinite(language_id.log_long(pieces, np.tile(codes, 400), p)).all()


def twins(n: int) -> tuple[str, str]:
    """Two different texts of n letters that every polynomial hash modulo 2^64 takes for one."""
    a = "".join("tq"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("tq", "qt"))


@pytest.mark.parametrize("n", [16, 100, 127, 128, 1024, 4096])
def test_texts_that_polynomials_confuse(spark, n):
    a, b = twins(n)
    d = spark.createDataFrame([(1, f"{a}\n{b}\n{a}"), (2, " ".join([a, b] * 8)), (3, a), (4, b), (5, f"{a}\n{b}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.repetition(d).collect()}
    assert (got[1]["n_dup_lines"], got[5]["n_dup_lines"], got[2]["n_repeat_words"]) == (1, 0, 16)
    vocabulary = token_counts.load(P.path("byte_bpe_multi_50k.tiktoken"))
    one = token_counts.Automaton(vocabulary)
    each = [int(one.count(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([n]))[0]) for x in (a, b)]
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d, P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert [counted[i] for i in (3, 4, 5)] == [*each, sum(each)]
    found = language_id.Words([a, b, f"{a} {b} {a}"])
    assert len(found.sizes) == 2 and found.code.tolist() == [found.code[0], found.code[1], found.code[0], found.code[1], found.code[0]]


def test_span_hashes():
    raw = np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8)
    starts = np.random.default_rng(3).integers(0, 4000, 600)
    ends = starts + np.random.default_rng(4).integers(0, 300, 600)
    want = [xxhash.xxh64_intdigest(raw[s:e].tobytes(), 42) for s, e in zip(starts, ends)]
    assert common.span_hashes(raw, starts, ends, 42, below=32).tolist() == want
    own = common.span_hashes(raw, starts, ends)
    assert len(set(own.tolist())) == len({raw[s:e].tobytes() for s, e in zip(starts, ends)})


def test_quality_is_found_in_held_out_texts(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = rule_ensemble.score(docs(spark), rule_ensemble.fit(docs(spark), labels)).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.9 * got.count()


def test_rules_of_a_path():
    rule = rule_ensemble.simplified((("a", None, 3.0), ("b", 1.0, None), ("a", None, 2.0), ("a", 0.5, None)))
    assert rule == (("a", 0.5, 2.0), ("b", 1.0, None))


def test_passages_against_brute_force(spark):
    own = {i: [w.lower() for w in WORD.findall(t)] for i, t in texts(spark).items()}
    where = defaultdict(set)
    for i, w in own.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    found = compact_windows.repeated_passages(docs(spark)).collect()
    class_of = {i: i for i in own}

    def root(i: int) -> int:
        while class_of[i] != i:
            i = class_of[i]
        return i

    spans = defaultdict(list)
    for r in found:
        spans[r["doc_id"]].append((r["first_word"], r["last_word"]))
        spans[r["match_doc_id"]].append((r["match_first_word"], r["match_last_word"]))
        class_of[root(r["doc_id"])] = root(r["match_doc_id"])
    for passage, ids in where.items():
        if len(ids) > 1:  # every repeat of 50 words: its documents are of one class
            assert len({root(i) for i in ids}) == 1
    for i, w in own.items():  # and each place of it is inside a row's span
        for j in range(len(w) - 49):
            if len(where[tuple(w[j : j + 50])]) > 1:
                assert any(s <= j and j + 49 <= e for s, e in spans[i])
    for r in found:
        a, b = own[r["doc_id"]][r["first_word"] : r["last_word"] + 1], own[r["match_doc_id"]][r["match_first_word"] : r["match_last_word"] + 1]
        x, y = (Counter(tuple(s[j : j + 5]) for j in range(len(s) - 4)) for s in (a, b))
        assert min(len(a), len(b)) >= 50 and sum((x & y).values()) / sum((x | y).values()) >= 0.8


def test_planted_near_passage_is_found(spark):
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    passage = fresh(80)
    edited = passage[:40] + ["other"] + passage[41:]
    rows = [(1, " ".join(fresh(100) + passage + fresh(50))), (2, " ".join(fresh(30) + edited + fresh(90))), (3, " ".join(fresh(300)))]
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["match_doc_id"], r["first_word"], r["match_first_word"]) for r in found] == [(2, 1, 30, 100)]


@pytest.mark.parametrize("n", [50, 60, 80, 85])
def test_passage_with_a_phrase_that_stands_earlier_too(spark, n):
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    passage = fresh(n)
    half = n // 2
    for earlier in (passage[half : half + 5], passage[: half + 10], passage[:-2]):  # one phrase of it, and quotes of its first part
        rows = [(1, " ".join(fresh(20) + earlier + fresh(30) + passage + fresh(20))), (2, " ".join(fresh(30) + passage + fresh(40)))]
        found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert (2, 1, 30, 50 + len(earlier)) in [(r["doc_id"], r["match_doc_id"], r["first_word"], r["match_first_word"]) for r in found]


@pytest.mark.parametrize("n, held", [(56, 48), (51, 49), (56, 45), (50, 30), (60, 8)])
def test_passage_of_which_lesser_documents_have_a_part(spark, n, held):
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(40):
        passage = fresh(n)
        parts = [passage[:held], passage[-held:], passage[n // 3 : n // 3 + held // 2], passage, passage]
        rows += [(10 * k + i, " ".join(fresh(30) + part + fresh(30))) for i, part in enumerate(parts)]
        want.add((10 * k + 4, 10 * k + 3, 30, 30 + n - 1))
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {(r["doc_id"], r["match_doc_id"], r["first_word"], r["last_word"]) for r in found}
    assert want <= linked and len(linked) == len(found)


def test_lesser_documents_that_hold_least_shingles_hide_nothing(spark):
    """Lesser documents hold every shingle of a passage, alone or with its neighbours, in other surroundings."""
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    passage = fresh(50)
    rows = [(j, " ".join(sum((fresh(10) + passage[k : k + 5 + j] for k in range(46)), []))) for j in range(12)]
    rows += [(50, " ".join(fresh(30) + passage + fresh(30))), (51, " ".join(fresh(7) + passage + fresh(60)))]
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["match_doc_id"], r["first_word"], r["last_word"], r["match_first_word"]) for r in found if r["doc_id"] >= 50] == [(51, 50, 7, 56, 30)]


def test_recall_of_edited_passages(spark):
    """Of passages of 60 to 200 words with a word changed, put in or left out for every 50, at least 0.97 are linked."""
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(300):
        passage = fresh(random.randrange(60, 200))
        edited = list(passage)
        for _ in range(len(passage) // 50):
            at = random.randrange(len(edited))
            edited[at : at + random.choice((0, 1))] = fresh(random.choice((0, 1, 1)))
        a, b = (Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4)) for x in (passage, edited))
        if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
            want.add((2 * k + 1, 2 * k))
        rows += [(2 * k, " ".join(fresh(40) + passage + fresh(40))), (2 * k + 1, " ".join(fresh(30) + edited + fresh(50)))]
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {(r["doc_id"], r["match_doc_id"]) for r in found}
    assert len(want & linked) >= 0.97 * len(want) > 200


def test_rows_of_one_document_and_hot_passages(spark):
    fresh = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(i, " ".join(fresh(20) + passage + fresh(20))) for i in range(400)] + [(0, " ".join(passage + fresh(5))), (None, " ".join(passage)), (7000, " ".join(passage[:49]))]
    found = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} | {r["match_doc_id"] for r in found} == set(range(400))
    class_of = {i: i for i in range(400)}
    for r in found:
        a, b = class_of[r["doc_id"]], class_of[r["match_doc_id"]]
        class_of = {i: min(a, b) if c in (a, b) else c for i, c in class_of.items()}
    assert set(class_of.values()) == {0} and len(found) < 400 * 10


def test_a_rewritten_sentence_parts_no_long_passage():
    a = common.mixed(np.arange(1, 401, dtype=np.uint64))
    b = np.concatenate([a[:200], common.mixed(np.arange(1000, 1020, dtype=np.uint64)), a[220:]])
    assert compact_windows.passages(a, b, np.array([50]), np.arange(len(b))) == [(0, 399, 0, 399, 380 / 420)]


def test_compact_windows_cover_every_subsequence_once():
    values = common.mixed(np.array([random.randrange(12) for _ in range(60)], np.uint64))
    doc, c, left, right = compact_windows.windows(values, np.array([0, 25, 60]), 6)
    first = {}
    for lo, hi in ((0, 25), (25, 60)):
        for i in range(lo, hi):
            for j in range(i + 5, hi):
                first[i, j] = min(values[i : j + 1])
    covered = Counter()
    for m, x, y in zip(c.tolist(), left.tolist(), right.tolist()):
        for i in range(x, m + 1):
            for j in range(max(m, i + 5), y + 1):
                covered[i, j] += 1
                assert values[m] == first[i, j]
    assert set(covered) == set(first) and set(covered.values()) == {1}


def test_avi_round_trip_and_digests(spark):
    got = {r["doc_id"]: r for r in avi.round_trip(docs(spark)).collect()}
    for i, text in texts(spark).items():
        raw = text.encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    media = avi.store(docs(spark))
    sizes = {r["doc_id"]: (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in media.collect()}
    assert all(sizes[i] == (r["media_bytes"], r["media_sha256"]) for i, r in got.items())
    clips = avi.clips(media)
    spans = clips.groupBy("doc_id").agg(F.sum(F.expr("last_frame - first_frame + 1")).alias("n")).collect()
    assert all(f"frames={r['n']};" in got[r["doc_id"]]["feature"] for r in spans)


def test_jpeg_decoder_reads_ac_coefficients():
    """A hand-made frame: one block, DC 16 and one horizontal coefficient."""
    tables = avi._segment(0xC4, b"\x00" + bytes([0, 1] + [0] * 14) + b"\x05") + avi._segment(0xC4, b"\x10" + bytes([0, 2] + [0] * 14) + b"\x00\x03")
    head = b"\xff\xd8" + avi._segment(0xDB, b"\x00" + bytes([8] * 64)) + avi._segment(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + tables + avi._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    bits = "00" + "10000" + "01" + "100" + "00"
    scan = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    header = avi.Header(head)
    got = avi.decode_blocks(header, [scan])[0, 0].reshape(8, 8)
    wave = [144 + 8 * 4 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * x + 1) * np.pi / 16) for x in range(8)]
    assert (got == np.rint(wave)).all()


def test_damaged_files_are_refused():
    good = avi.write_files(common.Texts.of(pa.array(["hello"])))[0][0]
    for bad in (good[:40], b"RIFF" + good[4:8] + b"WAVE" + good[12:], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            avi.read_files([bad])


def test_mixing_matches_sql_and_its_targets(spark, duck):
    got = {r["doc_id"]: r for r in mixing.mix(docs(spark)).collect()}
    want = duck.execute(mixing.ORACLE_SQL).df()
    assert {(r.doc_id, r.size, r.taken) for r in want.itertuples()} == {(i, r["size"], r["taken"]) for i, r in got.items()}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark).repartition(3)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    for source in docs(spark).select("source").distinct().collect():
        ids = [r["doc_id"] for r in docs(spark).where(F.col("source").eqNullSafe(source["source"])).collect()]
        taken, target = sum(got[i]["taken"] for i in ids), got[ids[0]]["target"]
        assert abs(taken - target) <= max(got[i]["size"] for i in ids) and target <= 2 * got[ids[0]]["source_size"]
    rows = mixing.mixed_rows(docs(spark)).groupBy("doc_id").count().collect()
    assert all(r["count"] * got[r["doc_id"]]["size"] == got[r["doc_id"]]["taken"] for r in rows)


def test_mixing_splits_ties(spark, monkeypatch):
    rows = [(None, "a b c d e", "x")] * 300 + [(7, "a " * n, "y") for n in range(1, 60)] + [(7, "a b", "y")] * 40 + [(None, None, "z")] * 5 + [(i, "w " * 9 + "#" * (i % 50), None) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    monkeypatch.setattr(mixing, "ENDING", 5)
    got = mixing.mix(d).collect()
    by_target = defaultdict(list)
    for r in got:
        by_target[r["source_size"], r["target"]].append(r)
    assert len(got) == len(rows) and len(by_target) == 4
    for (_, target), own in by_target.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max((r["size"] for r in own), default=0) / 2 + 1e-6 or not target
    again = mixing.mix(d.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    kept = Counter(r["doc_id"] for r in mixing.mixed_rows(d).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert all(kept[i] == n for i, n in want.items() if i is not None) and kept[7] == want[7]


def test_lines_whose_hashes_clash():
    keys, marks = np.array([5, 9], np.uint64), np.array([1, 2], np.uint64)
    shard = line_dedup.Shard.build(keys, marks, np.array([5, 6], np.int32), np.array([70, 80]), (np.array([5, 9], np.uint64), np.array([3, 4], np.uint64), np.array([7, 4], np.int32), np.array([90, 91])))
    shard = line_dedup.Shard.of(shard.columns())
    inside, keeper = shard.keeper_of(np.array([5, 5, 9, 9, 5], np.uint64), np.array([1, 3, 2, 4, 9], np.uint64), 5)
    assert inside.tolist() == [True, True, True, False, False] and keeper[:3].tolist() == [70, 90, 80]


def test_one_row_of_each_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s", 1), (5, a, "s", 2), (5, b, "s", 3), (5, b, "s", 3), (5, b, "t", 3), (None, a, "s", 4), (None, c, "s", 5), (None, c, "s", 6), (8, None, "s", 7), (9, "", "s", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    got = simhash.one_of_each(d).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(1, a), (5, b), (None, c), (8, None)} and len(got) == 4
    assert Counter(map(tuple, simhash.one_of_each(d.repartition(3)).collect())) == Counter(map(tuple, got))
    assert simhash.one_of_each(d.limit(0)).count() == 0


def test_repetition_against_brute_force(spark):
    own = texts(spark)
    for r in repetition.repetition(docs(spark)).collect():
        text = own[r["doc_id"]]
        w = WORD.findall(text)
        seen, lines = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        n8 = covered(w, 8)
        failed = len(w) < 20 or 100 * len(n8) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), lines, len(n8), failed)
        for n in repetition.COVERAGE:
            assert r[f"cover_{n}"] == pytest.approx(sum(len(w[j]) for j in covered(w, n)) / max(1, sum(map(len, w))))
        assert not (failed and r["kept"])


def covered(w: list[str], n: int) -> set[int]:
    grams = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    return {k for j in range(len(w) - n + 1) if grams[tuple(w[j : j + n])] > 1 for k in range(j, j + n)}


def test_line_dedup_matches_sql(spark, duck):
    want = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in duck.execute(line_dedup.ORACLE_SQL).df().itertuples()}
    assert {tuple(r) for r in line_dedup.report(docs(spark)).collect()} == want


def test_line_dedup_in_several_groups_of_shards(spark, monkeypatch):
    want = {tuple(r) for r in line_dedup.report(docs(spark)).collect()}
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "GROUP_BYTES", 200)
    assert {tuple(r) for r in line_dedup.report(docs(spark)).collect()} == want


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64))
    shard = line_dedup.Shard.build(keys, keys ^ np.uint64(7), np.ones(len(keys), np.int32), np.arange(len(keys)))
    again = line_dedup.Shard.of(shard.columns())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    inside, keeper = again.keeper_of(keys, keys ^ np.uint64(7))
    assert inside.all() and (keeper == np.arange(len(keys))).all()
    assert not again.keeper_of(keys + np.uint64(1), keys)[0].any()


def test_fingerprints_against_the_library(spark):
    own = texts(spark)
    for r in simhash.fingerprints(docs(spark)).collect():
        w = WORD.findall(own[r["doc_id"]].translate(LOWER))
        grams = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert r["fp"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [1000, 2])
def test_near_pairs_against_brute_force(spark, crowd):
    base = [random.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << i for i in random.sample(range(64), random.randrange(5))) for b in base for _ in range(8)} | {0, 1, 2**63, 2**64 - 1}
    fps |= {base[0] & ~0xFF | i for i in range(60)}
    want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    got = simhash.near_pairs(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), crowd).collect()
    assert {frozenset((r["src"] % 2**64, r["dst"] % 2**64)) for r in got} == want


def test_components_take_the_least_id(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(9, text), (4, text), (7, text.upper()), (2, "other text of its own"), (None, text), (1, None), (3, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 7: 4, None: 4, 2: 2, 1: 1, 3: 1}


def test_token_counts_against_greedy(spark):
    vocabulary = set(token_counts.load(P.path("byte_bpe_multi_50k.tiktoken")))
    longest = max(map(len, vocabulary))

    def greedy(word: str) -> int:
        raw, at, n = b" " + word.encode(), 0, 0
        while at < len(raw):
            at += next(k for k in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + k] in vocabulary)
            n += 1
        return n

    own = texts(spark)
    memo: dict[str, int] = {}
    for r in token_counts.token_counts(docs(spark), P.path("byte_bpe_multi_50k.tiktoken")).collect():
        each = [memo[w] if w in memo else memo.setdefault(w, greedy(w)) for w in WORD.findall(own[r["doc_id"]])]
        assert (r["n_words"], r["n_tokens"], r["longest_word_tokens"]) == (len(each), sum(each), max(each, default=0))
    long = "ab" * 400 + "日本" * 99
    a = token_counts.Automaton(sorted(vocabulary))
    raw = np.frombuffer(long.encode(), np.uint8)
    assert a.count(raw, np.array([0]), np.array([len(raw)])).tolist() == [greedy(long)]


def test_bpe_against_the_library(spark):
    import tiktoken

    table = bpe.Ranks.load(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    own = texts(spark) | {None: None} | {-1 - i: t for i, t in enumerate(HARD)}
    d = spark.createDataFrame([(i, t) for i, t in own.items()], "doc_id long, text string")
    for r in queries.encode_documents(d).collect():
        ids = library.encode_ordinary(own[r["doc_id"]] or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((own[r["doc_id"]] or "").encode()).hexdigest())


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    now = docs(spark)
    columns = now.columns
    kept = {}
    for name, stage in cp.STAGES:
        now = common.checkpointed(stage(spark, now, SMALL))
        kept[name] = now
        if name != cp.STAGES[-1][0]:
            assert now.columns == columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert kept["quality_classifier"].join(labels.where("quality = 0"), "doc_id").count() <= 0.05 * labels.where("quality = 0").count()
    assert labels.where("quality = 1").join(kept["quality_classifier"], "doc_id", "left_anti").count() <= 0.05 * labels.count()
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()}
    before = {r["doc_id"]: r["text"] for r in kept["quality_classifier"].collect()}
    holds = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in before.items():
        for line in t.split("\n"):
            holds[key(line)].add(i)
    gone = {k: max(ids) for k, ids in holds.items() if len(k) >= 40 and len(ids) >= 5}
    assert lines == {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in before.items()}
    dedup = {r["doc_id"]: r["text"] for r in kept["simhash_near_dedup"].collect()}
    marks = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(kept["line_dedup"]).collect()}
    assert set(dedup) == set(marks.values())
    copies = Counter(r["doc_id"] for r in kept["source_mixing"].collect())
    mixed = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(kept["simhash_near_dedup"]).collect()}
    assert all(copies[i] * size == taken for i, (size, taken) in mixed.items())
    assert kept["byte_bpe"].count() == sum(copies.values())
    assert set(kept["byte_bpe"].columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    whole = cp.run(spark, SMALL).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, kept["byte_bpe"].collect()))
    decoded = Counter()
    for i, n in copies.items():
        decoded[i, hashlib.sha256(dedup[i].encode()).hexdigest()] += n
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in whole) == decoded


def test_pipeline_stages_bear_hard_inputs(spark):
    import corpus_pipeline as cp

    for start in (hard(spark), empty(spark)):
        now = start
        for _, stage in cp.STAGES:
            now = common.checkpointed(stage(spark, now, SMALL))
        assert now.columns[0] == "doc_id"


def test_pipeline_keeps_columns_of_like_names_and_of_maps(spark):
    import corpus_pipeline as cp

    line = "One line of more than forty letters that stands in many documents."
    rows = [(i, f"{line}\n{' '.join(f'w{i}x{j}' for j in range(30))}", f"s{i % 2}", 77, {"k": i}) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, LINES_DROPPED_0 int, tags map<string,int>")
    lines = cp.line_dedup_stage(spark, d, SMALL)
    assert lines.columns == d.columns and {r["LINES_DROPPED_0"] for r in lines.collect()} == {77} and lines.where(F.contains("text", F.lit(line))).count() == 1
    with pytest.raises(ValueError):
        line_dedup.drop_lines(d, "lines_dropped_0")
    twice = simhash.one_of_each(d.unionAll(d)).collect()
    assert sorted((r["doc_id"], r["tags"]["k"]) for r in twice) == [(i, i) for i in range(8)]


def test_rows_without_words_are_taken_in_complete_epochs_only(spark):
    rows = [(i, "" if i % 4 == 0 else "a b c", "full" if i % 2 else "other") for i in range(400)] + [(1000 + i, "w " * 2000, "rich") for i in range(20)]
    d = spark.createDataFrame([(i, "" if i % 5 == 0 and s == "full" else t, s) for i, t, s in rows], "doc_id long, text string, source string")
    by_source = {r["source"]: r for r in mixing.targets(d.select("source", mixing.size_of(F.col("text")).alias("size"))).collect()}
    assert by_source["full"]["target"] == 2 * by_source["full"]["source_size"]
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(d).collect())
    assert {copies[i] for i, _, s in rows if s == "full"} == {2}


def test_every_llm_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
