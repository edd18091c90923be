"""Operators over texts against plain Python versions."""

import hashlib
import io
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import bpe, hashing, media, ngram_join, packing, substring_dedup, token_files, vocabulary
from barloom.llm.components import connected_components
from barloom.llm.rans import BlockError, Decoder, FrequencyTable, encode

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(*frames):
    return [(r.doc_id, r.text or "") for f in frames for r in f.select("doc_id", "text").collect()]


def removed(docs, window):
    words = [WORD.findall(t.encode()) for _, t in docs]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_substring_dedup(request, which):
    docs = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.removal_report(docs)))
    assert got == removed(texts(docs), 35)


def test_substring_dedup_keeps_columns_and_clean_texts(odd, nothing):
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[8] == "Once  upon\ta\ntime… ñandú 中文 🙂"
    assert by[2] == "tail" and by[4] is None
    assert substring_dedup.removal_report(nothing).count() == 0


def components(docs, size, num, den):
    sets = []
    for _, t in docs:
        w = [x.lower() for x in WORD.findall(t.encode())]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for g in s for j in index[g] if j < i).items():
            if den * shared >= num * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(docs))


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("which", ["odd", "documents"])
def test_ngram_join(request, which, size, num):
    docs = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.similar_components(docs, size, num, 100)))
    assert got == components(texts(docs), size, num, 100)


def test_ngram_join_of_texts_just_below_the_threshold(spark):
    """Many texts share a passage; some are similar, most just not, in all sizes."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(120)]
    given = []
    for i in range(260):
        own = [f"o{i}x{j}" for j in range(int(rng.integers(2, 18)))]
        at = int(rng.integers(0, 121))
        given.append((i, " ".join(passage[:at] + own + passage[at:] if i % 3 else own + passage)))
    for i in range(260, 300):
        words = given[int(rng.integers(260))][1].split()
        words[int(rng.integers(len(words)))] = f"c{i}"
        given.append((i, " ".join(words)))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for size, num in ((3, 90), (5, 80)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.similar_components(docs, size, num, 100)))
        assert got == components(given, size, num, 100)


def test_one_of_each(odd, nothing):
    kept = sorted((r.doc_id for r in ngram_join.one_of_each(odd).collect()), key=str)
    assert kept == sorted([1, 10, 4, 5, 6, 7, 8, 9, None, None], key=str)
    assert ngram_join.one_of_each(nothing).count() == 0


def test_chosen_prefix_never_misses():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.choice(1 << 40, size=int(rng.integers(12, 60)), replace=False).astype(np.uint64)
        b = np.concatenate([a[: int(len(a) * rng.uniform(0.85, 1))], rng.integers(0, 1 << 40, size=2).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        sketch = rng.integers(1, 200, size=ngram_join.CELLS).astype(np.int32)
        shared = len(np.intersect1d(a, b))
        if 10 * shared >= 8 * (len(a) + len(b) - shared) and len(a) != shared:
            (k, p), (m, q) = (ngram_join.chosen_prefix(x, sketch, 8, 10) for x in (a, b))
            assert len(np.intersect1d(p, q)) >= min(k, m)


SPECIAL = ["hello <|endoftext|> world", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|> x", " <|endoftext|> "]


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_added_tokens_as_the_library_has_them(name, style):
    path = vocabulary.public_path(name)
    plain = Tokenizer.from_file(path)
    got = vocabulary.PieceEncoder(path, style, "<u4").encode([*SPECIAL, "none here", ""])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in [*SPECIAL, "none here", ""]]


def morse(a, b, size):
    """The word whose polynomial hash modulo 2**64 equals that of its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_collide_under_polynomials(spark):
    one, other = morse("a", "b", 4096)
    hashes = hashing.words_of([one, other, one]).hashes
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    for name, style in (("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")):
        path = vocabulary.public_path(name)
        got = vocabulary.PieceEncoder(path, style, "<u4").encode([one, other])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in (one, other)]
    more = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {more}"), (4, f"{other} {more[:60]}")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.similar_components(docs, 3, 90, 100).collect()} == {(i, i) for i in range(1, 5)}
    long = spark.createDataFrame([(i, " ".join([w] * 40)) for i, w in enumerate((one, other))], "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.removal_report(long))) == removed(texts(long), 35)


def test_pieces_of_the_same_first_hash_stay_apart(monkeypatch):
    real = vocabulary.word_hashes
    monkeypatch.setattr(vocabulary, "word_hashes", lambda *a: [real(*a)[0] % np.uint64(3), real(*a)[1]])
    memory = vocabulary.PieceMemory(lambda pieces: [p.decode() for p in pieces], vocabulary.leading_pieces)
    for text in ("one two three four five six one", "six two seven one"):
        assert "".join(memory.look_up([text])[0]) == text


def test_words_are_spans_between_ascii_space():
    given = ["a\x0bb\x1cc  d", "", "é f g"]
    words = hashing.words_of(given)
    assert np.diff(words.first).tolist() == [len(WORD.findall(t.encode())) for t in given]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    path = vocabulary.public_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = rows(packing.pack_documents(docs, path))
    want = Counter()
    for doc_id, text in texts(docs):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        for k, s in enumerate([0, *range(head, len(ids), 2048)]):
            piece = ids[s : head if k == 0 else s + 2048]
            want[doc_id, k, s, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= 1.03 * sum(r["length"] for r in got) / 2048 + 2


def test_pack_lengths_few_sizes():
    where, _ = packing.pack_lengths(np.array([1000, 1048] * 50 + [700] * 3))
    assert len(set(where.tolist())) == 52
    assert packing.pack_lengths(np.zeros(0, dtype=np.int64))[0].tolist() == []


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_byte_level_bpe(request, which):
    docs = request.getfixturevalue(which)
    path = vocabulary.public_path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for doc_id, text in texts(docs):
        ids = own.encode_ordinary(text)
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()) == want


def test_pieces_keep_the_matches_of_the_pattern():
    letters = ["a", "B", "é", "ß", "×", "÷", "ª", "1", "23", "٣", "Σ", "e\u0301", "≠", "<\u0338", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", ",", ".", "(", "_", "日", "👍", "\x00", "\x7f", "½"]
    rng = np.random.default_rng(3)
    given = ["".join(rng.choice(letters, size=n)) for n in rng.integers(0, 25, 4000)]
    offsets = np.cumsum([0, *(len(t.encode()) for t in given)])
    data = "".join(given).encode()
    begin, end, first = vocabulary.leading_pieces(np.frombuffer(data, np.uint8), offsets)
    find = regex.compile(public_tokenizers.PATTERN).findall
    for i, text in enumerate(given):
        assert [m for k in range(first[i], first[i + 1]) for m in find(data[begin[k] : end[k]].decode())] == find(text)
    for name, style in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        own = vocabulary.encoder(vocabulary.public_path(name), style, "<u4")
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(given)] == [e.ids for e in own.tokenizer.encode_batch(given, add_special_tokens=False)]


def test_bpe_merge_order_where_a_later_pair_is_lower():
    ranks = {bytes([i]): i for i in range(256)} | {b"abx": 300, b"bx": 301, b"ab": 302, b"aa": 303, b"aab": 304}
    words = [b"abx", b"abxabx", b"aaaa", b"aaab", b"aaaaabxaab", b"ababab"]
    words += [w * n for w in words for n in (6, 7, 11, 16, 17, 40)]
    got = bpe.DuckBpe(ranks).run(words)
    own = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    assert [ids for ids, _ in got] == [",".join(map(str, own.encode_ordinary(w.decode()))).encode() for w in words]
    assert [data for _, data in got] == words


def test_bpe_of_long_words():
    ranks = bpe.read_ranks(vocabulary.public_path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    engine, rng = bpe.DuckBpe(ranks), np.random.default_rng(2)
    words = ["".join(rng.choice(list(alphabet), size=n)) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "=-", "ñéü中文字", "a ") for n in (65, 300, 3000)] + ["a" * 8000, "ab" * 3000]
    got = engine.run([w.encode() for w in words])
    assert [ids for ids, _ in got] == [",".join(map(str, own.encode_ordinary(w))).encode() for w in words]
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=100_000)).encode()
    assert engine.run([letters])[0][1] == letters
    odd = {bytes([i]): i for i in range(256)} | {b"abx": 300, b"bx": 301, b"ab": 302, b"aa": 303, b"aab": 304, b"xa": 299, b"bxa": 290}
    own = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=odd, special_tokens={})
    words = ["".join(rng.choice(list("abx"), size=n)) for n in rng.integers(65, 200, 300)]
    assert [ids for ids, _ in bpe.DuckBpe(odd).run([w.encode() for w in words])] == [",".join(map(str, own.encode_ordinary(w))).encode() for w in words]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_token_files(request, which):
    docs = request.getfixturevalue(which)
    path = vocabulary.public_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want, at = Counter(), 0
    for doc_id, text in sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want[doc_id, at if doc_id is not None else None, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
        at += len(ids)
    got = token_files.token_file_round_trip(docs, path).collect()
    assert Counter((r.doc_id, r.start if r.doc_id is not None else None, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_files_are_read_by_another_session(spark, documents, tmp_path):
    """Files alone are enough, and a hot doc_id takes several parts."""
    path = vocabulary.public_path("word_bpe_49k.json")
    hot = documents.select("doc_id", "text").unionByName(spark.range(4000).selectExpr("7 AS doc_id", "concat('same ', id % 50) AS text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(hot, str(tmp_path / "t"), path, 2, 49_408)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(spark.newSession(), str(tmp_path / "t")).collect()
    assert len(got) == hot.count()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
    assert len({r.part for r in spark.read.parquet(str(tmp_path / "t" / "blocks")).filter("array_contains(doc_ids, 7)").collect()}) > 1
    token_files.write_token_files(hot.limit(0), str(tmp_path / "none"), path, 2, 49_408)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_case_is_folded_as_the_tokenizer_does():
    path = vocabulary.public_path("word_bpe_49k.json")
    own = vocabulary.encoder(path, "dropped", "<u2")
    given = ["W\u030a IT'S The THE", "H\u0331 J\u030c I\u0307 \u0130x E\u0301TE\u0301", "ΣΑΣ ÀB K"]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(given)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in given]


def test_blocks_decode_from_checkpoints_and_notice_damage():
    ids = np.random.default_rng(0).zipf(1.3, 700_000) % 5000
    table = FrequencyTable.of_counts(np.bincount(ids, minlength=5000))
    data = encode(ids, table)
    own = Decoder(table)
    assert (own.decode(data) == ids).all()
    assert (own.decode(data, 1, 2) == ids[2048 * 128 : 2 * 2048 * 128]).all()
    assert own.decode(encode(ids[:0], table)).tolist() == []
    assert all((own.decode(encode(ids[:n], table)) == ids[:n]).all() for n in (1, 5, 64, 130, 5000))
    assert len(encode(ids[:5], table)) < 60
    with pytest.raises(BlockError):
        own.decode(data[:-4])
    with pytest.raises(BlockError):
        own.decode(data[:-8] + b"\1\2\3\4\5\6\7\7")


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_media(request, which):
    docs = request.getfixturevalue(which)
    want = Counter()
    for doc_id, text in texts(docs):
        data = text.encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        want[doc_id, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest()] += 1
    got = media.text_media(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    for doc_id, text in texts(docs):
        if doc_id is not None and len(text) < 20_000:
            assert {r.feature for r in got if r.doc_id == doc_id and r.n_bytes == len(text.encode())} == {slow_hash(text)}


def slow_hash(text):
    """The difference hash by adding up parts of samples one by one."""
    data = text.encode()
    padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    rows_ = len(padded) // 64
    bits = ""
    for y in range(8):
        cells = []
        for x in range(9):
            total = Fraction(0)
            for r in range(y * rows_ // 8, -(-(y + 1) * rows_ // 8)):
                high = min(Fraction(r + 1), Fraction((y + 1) * rows_, 8)) - max(Fraction(r), Fraction(y * rows_, 8))
                for c in range(x * 64 // 9, -(-(x + 1) * 64 // 9)):
                    wide = min(Fraction(c + 1), Fraction((x + 1) * 64, 9)) - max(Fraction(c), Fraction(x * 64, 9))
                    total += high * wide * padded[64 * r + c]
            cells.append(int(np.rint(float(total / (Fraction(rows_, 8) * Fraction(64, 9))))))
        bits += "".join("1" if a < b else "0" for a, b in zip(cells, cells[1:], strict=False))
    return f"{int(bits, 2):016x}"


def test_images():
    grey = np.arange(6 * 10, dtype=np.uint8).reshape(6, 10)
    for data in (media.encode_pgm(grey), media.encode_bmp(grey), b"P2\n# c\n10 6\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())):
        assert (media.decode(data) == grey).all()
    assert media.decode(b"P6\n1 1\n255\n\1\2\3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P3 1#c\n 1 7 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 2 65535 \1\2\3\4").tolist() == [[0x102], [0x304]]
    assert media.decode(b"P1\n# c\n3 2\n101\n0 1 0").tolist() == media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    small = media.area_resize(grey, 3, 5)
    assert np.allclose(small, grey.reshape(3, 2, 5, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(grey, 4, 7).mean(), grey.mean())


def bmp(width, height, bits, palette, body):
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 0, 0, len(palette) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(palette) + len(body), 0, 0, 54 + len(palette)) + head + palette + body


def test_bitmaps_of_few_and_many_bits():
    two = bytes([0, 0, 0, 0, 255, 255, 255, 0])
    assert media.decode(bmp(3, -2, 1, two, b"\xa0\0\0\0\x40\0\0\0")).tolist() == [[255, 0, 255], [0, 255, 0]]
    colours = bytes([10, 20, 30, 0, 1, 2, 3, 0])
    assert media.decode(bmp(3, 1, 4, colours, b"\x01\x10\0\0")).tolist() == [[[30, 20, 10], [3, 2, 1], [3, 2, 1]]]
    assert media.decode(bmp(1, 1, 24, b"", b"\1\2\3\0")).tolist() == media.decode(bmp(1, 1, 32, b"", b"\1\2\3\0")).tolist() == [[[3, 2, 1]]]
    assert media.decode(bmp(2, 1, 16, b"", struct.pack("<HH", 0x7C00, 0x001F))).tolist() == [[[255, 0, 0], [0, 0, 255]]]


def test_images_that_cannot_be_read(spark):
    whole = media.encode_bmp(np.zeros((3, 5), dtype=np.uint8))
    bad = [b"", b"P5\n9 9\n255\n", b"BM", b"GIF89a", whole[:-3], whole[:60], b"P5" + b" " * 60 + b"x", b"P5" + b"#a\n " * 5000, b"P5 0 4 255 ", b"P2 2 1 255 1 x", b"P2 2 1 255 1 300", b"P5 99999999999 99999999999 255 1", bmp(1, 1, 8, bytes(4), b"\5\0\0\0")]
    for data in bad:
        with pytest.raises(media.MediaError):
            media.decode(data)
    rows_ = [(i, 1, b) for i, b in enumerate([*bad, media.encode_pgm(np.zeros((1, 64), dtype=np.uint8)), None])]
    out = {r.doc_id: r for r in media.media_features(spark.createDataFrame(rows_, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(out) == len(rows_) and all((out[i].error is None) == (i == len(bad)) for i in out)
    assert out[0].feature is None and out[len(bad)].payload_bytes == 64


def test_deep_samples_are_scaled():
    deep = np.arange(72, dtype=np.uint16).reshape(8, 9) * 900
    shallow = np.load(io.BytesIO(media.npy_tile(media.Image(deep, 65535))))
    assert shallow.max() == round(71 * 900 * 255 / 65535) and media.difference_hash(media.npy_tile(media.Image(deep, 65535))) == "ff" * 8


def test_components_of_few_edges_take_few_jobs(spark):
    """Every round of the contraction costs the driver plans, tasks and broadcasts; few edges need none."""
    order = np.random.default_rng(5).permutation(60).tolist()
    pairs = [*zip(order, order[1:40], strict=False), *zip(order[40:], order[41:], strict=False), (3, 3), (None, 4), (-7, 1 << 62), (order[0], order[1]), (order[1], order[0])]
    edges = spark.createDataFrame(pairs, "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    got = Counter((r.node, r.component) for r in connected_components(edges).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {**dict.fromkeys(order[:40], min(order[:40])), **dict.fromkeys(order[40:], min(order[40:])), -7: -7, 1 << 62: -7}
    assert got == Counter(want.items())
    assert Counter((r.node, r.component) for r in connected_components(edges, few=0).collect()) == got
    assert connected_components(edges.limit(0)).count() == connected_components(edges.limit(0), few=-1).count() == 0
    assert jobs <= 12, jobs
