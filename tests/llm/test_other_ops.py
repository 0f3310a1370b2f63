"""HTML extraction, media columns, packing, embeddings, mixing, pipeline."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import embed, media, packing
from factloom.llm.entry import tokenizer_paths

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, media int"
TEXTS = ["hello world", None, "", "é" * 100, "x" * 64, "<|endoftext|> is text", "w " * 30_000, "hello world", "0\0" * 10]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "q", 1) for d, t, s in rows], DOCS)


# media


def test_media_round_trip(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "null id", "s"), (3, "again", "s")]
    got = media.media_columns(spark, frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.encode(t or "")
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.describe(payload)] += 1
    assert Counter(map(tuple, got)) == want
    assert media.media_columns(spark, frame(spark, [])).collect() == []


def test_members_are_read_by_range_and_tried_again(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i} " * 50, "s") for i in range(200)]).repartition(1)
    files = media.write_archives(docs, str(tmp_path), archive_mb=0).where("members > 0").collect()
    assert len(files) == 200  # every archive is closed at its limit
    big = media.write_archives(docs, str(tmp_path / "b" if (tmp_path / "b").mkdir() is None else ""), archive_mb=64).collect()
    path = next(r.path for r in big if r.members)
    reader = media.ArchiveReader({"archives": f'[["{path}", {__import__("os").path.getsize(path)}]]', "rangeBytes": "4096", "tries": "3"})
    parts = reader.partitions()
    assert len(parts) > 3
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == list(range(200))

    class Flaky:
        def __init__(self, where):
            self.where, self.failures = where, 2

        def open_input_file(self, p):
            if self.failures:
                self.failures -= 1
                raise OSError("lost")
            return self.where.open_input_file(p)

    where, p = media._open(path)
    import zipfile

    info = zipfile.ZipFile(path).infolist()[5]
    assert media.decode(reader.member(media.Source(Flaky(where), p), info))[0].startswith(b"text ")
    assert len(reader.directory(media.Source(Flaky(where), p))) == 200
    reader.tries = 2
    with pytest.raises(OSError, match="lost"):
        reader.member(media.Source(Flaky(where), p), info)
    with pytest.raises(OSError, match="lost"):
        reader.directory(media.Source(Flaky(where), p))

    class Short:  # a header cut short is tried again, not passed on

        def open_input_file(self, _):
            return io.BytesIO(b"PK")

    with pytest.raises(OSError, match="no local header"):
        reader.member(media.Source(Short(), p), info)
    damaged = bytearray(media.encode("abc"))
    damaged[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(damaged))


def library_samples(png):
    """A PNG's grey samples by another decoder: plain zlib over its IDAT chunks, filter bytes checked."""
    import struct

    at, data, size = 8, b"", None
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        size = struct.unpack(">II", png[at + 8 : at + 16]) if kind == b"IHDR" else size
        data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    raw = zlib.decompressobj().decompress(data)
    rows = [raw[i : i + size[0] + 1] for i in range(0, len(raw), size[0] + 1)]
    assert len(rows) == size[1] and all(r[0] == 0 for r in rows)
    return b"".join(r[1:] for r in rows)


def test_very_long_texts_go_through_media_columns(spark):
    text = "é0" * 2_000_000
    got = media.media_columns(spark, frame(spark, [(1, text, "s"), (2, "x", "s")])).collect()
    raw = text.encode()
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == len(raw) == 6_000_000 and by[1].payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()
    assert library_samples(media.encode("abc é"))[:6] == "abc é".encode()


# packing


def test_pieces_hold_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(100 + i, "some words here " * rng.randrange(1, 600), "s") for i in range(60)] + [(None, "null id", "s")]
    got = packing.pack(frame(spark, rows).repartition(3), *tokenizer_paths(), open_windows=4).collect()
    encode = packing.tokenizer(tokenizer_paths()[0], None)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, t, _ in rows:
        ids = [*encode(t or ""), 0]
        mine = sorted(pieces[d], key=lambda r: r.start)
        assert b"".join(r.ids for r in mine) == np.array(ids, "<u4").tobytes() and [r.start for r in mine] == list(np.cumsum([0, *[r.length for r in mine]])[:-1])
        assert all(r.doc_tokens == len(ids) for r in mine)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *[r.length for r in s]])[:-1]) and sum(r.length for r in s) <= 1024
    tokens = sum(r.length for r in got)
    assert len(seqs) * 1024 - tokens < 0.1 * tokens + 3 * 1024
    assert packing.pack(frame(spark, []), *tokenizer_paths()).collect() == []


def test_quick_ranks_equal_the_tokenizer():
    path, ranks = tokenizer_paths()
    slow, quick = packing.tokenizer(path, None), packing.tokenizer(path, ranks)
    rng = random.Random(5)
    for _ in range(400):
        t = "".join(chr(rng.choice([32, 10, 39, 46, 48, 97, 101, 115, 228, 8217, 20013, 128512, 65, 0x0301])) for _ in range(rng.randrange(40)))
        assert slow(t) == quick(t), t
    assert slow("a<|endoftext|>b") == quick("a<|endoftext|>b")


def test_long_runs_of_one_character_give_the_tokenizers_ids():
    path, ranks = tokenizer_paths()
    slow, quick = packing.tokenizer(path, None), packing.tokenizer(path, ranks)
    kinds = [" ", "\n", "\t", "\xa0", "\u2028", "\x1c", "\x85", "\u200b", "a", "'", "s", "1", "!", "\xe9"]
    for x in kinds:
        for y in kinds:
            for w in kinds[:7]:
                t = x + y + w * 205 + y + x
                assert slow(t) == quick(t), (x, y, w)
    for c in (" ", "\n", "a", "'s", " \n"):
        for tail in ("", "x"):
            t = c * (1_000_000 // len(c)) + tail
            assert slow(t) == quick(t), (c, tail)


def test_windows_are_best_fit_and_bounded():
    w = packing.Windows(2, 10, 0)
    assert w.put(6, ["a"]) == [] and w.put(7, ["b"]) == []
    assert w.put(3, ["c"]) == [(0, ["b", "c"])]  # fills the fullest it fits
    assert w.put(9, ["d"]) == [] and w.put(8, ["e"]) == [(1, ["d"])] and len(w.open) == 2


# embeddings


def brute_links(rows):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            unit[k] = a / np.linalg.norm(a)
    near = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= 0.95] for k in unit}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(near.get(k, [])), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"max_centres": 32, "block": 20}, {"sample": 5, "block": 7}])
def test_links_equal_brute_force(spark, options):
    rng = np.random.default_rng(4)
    mids = rng.normal(size=(6, 8))
    rows = [(i, (mids[i % 6] + rng.normal(size=8) * [0.05, 0.3, 1.0][i % 3]).tolist()) for i in range(90)]
    rows += [(200 + k, rows[0][1]) for k in range(5)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, []), (304, [1.0, 2.0]), (305, [2.0, 4.0]), (306, [float("inf")] * 8), (307, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, kept string, n_links int")
    got = embed.links(df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert embed.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(r) for r in embed.links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_keep_first_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (None, [1.0, 0.0], 3), (5, None, 4)], "vec_id long, embedding array<double>, _id int")
    assert sorted(r._id for r in embed.keep_first(df).collect()) == [2, 3, 4]


def test_cover_tree_levels_nest():
    x = np.random.default_rng(0).normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = embed.CoverTree(x, 200)
    assert t.levels == sorted(t.levels) and t.levels[0] == 1
    for i, n in enumerate(t.levels[1:], 1):
        radius = 2 / 2**i
        far = embed._distances(t.centres[:n], t.centres[:n])
        np.fill_diagonal(far, 9)
        assert far.min() > radius and embed._distances(x, t.centres[:n]).min(1).max() <= radius
