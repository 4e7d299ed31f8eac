"""Tokenizing, packing, near-duplicates and passages against the libraries and brute force."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from cohortlens.llm import bpe, neardup, packing, passages, words
from cohortlens.llm.common import word_hashes
from llm_cases import docs, nothing, rows  # noqa: F401

RANKS, WORDS, BYTES = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = [
    "a", "b", " ", "  ", "\n", "\t", " \n", "é", "😀", "'s", "'S", "12", "!!", "\x1c", "\x85", "\xa0", "　", "中", "ab" * 200,
    "the" * 100, "z" * 700, "\0", " the", "\n\n", "\u2003", "\u0130", "caf\u00e9 ", "\u00aa", " <|endoftext|>", "á", "İ", "ΑΣ", "<|endoftext|>", "\1",
]


def made(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(values, counts):
    return [list(x) for x in np.split(values, np.cumsum(counts)[:-1])]


def test_bpe_equals_the_library(library):
    texts = [*made(600, 1), "".join(random.Random(2).choice("abcdefghij") for _ in range(5000))]
    found = bpe.Encoder(RANKS, P.PATTERN).encode(texts)
    assert split(*found) == [library.encode_ordinary(t) for t in texts]


def test_bpe_round_trip_of_a_table(spark, docs, nothing, rows, library):
    found = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.data)) for r in found) == Counter((i, (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("kind, path", [(words.LowerWords, WORDS), (words.SpacedWords, BYTES)])
def test_word_ids_equal_the_library(kind, path):
    library = Tokenizer.from_file(path)
    encoder = kind(path)
    for texts in (["İl Aİ", "some <|endoftext|> mark"], made(3000, 3), made(600, 4), ["", " ", "   ", "a   b", "a\n  b "]):
        found = encoder.encode(pa.array(texts), 1)
        assert split(*found) == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("width", [2048, 7])
def test_packing_is_a_stream_without_gaps(docs, rows, width):
    library = Tokenizer.from_file(WORDS)
    pieces = packing.pack(docs, WORDS, width).collect()
    assert all(len(p.ids) == 4 * p.length and p.offset + p.length <= width for p in pieces)
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = [p.sequence_id * width + p.offset for p in stream]
    assert at == list(np.cumsum([0] + [p.length for p in stream[:-1]]))
    documents, ids = [], []
    for p in stream:
        assert p.start == len(ids)
        ids.extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
        if len(ids) == p.doc_tokens:
            documents.append((p.doc_id, tuple(ids)))
            ids = []
    want = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows]
    assert not ids and Counter(documents) == Counter(want)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORDS).count() == 0


def brute_groups(rows, width, share):
    of = {}
    for i, t in rows:
        if i is not None:
            of.setdefault(i, []).append(neardup.shingles(neardup.cells(t or ""), width))
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(of):
        for b in sorted(of):
            if a < b and any(neardup.linked(x, y, share) for x in of[a] for y in of[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in of}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(docs, rows, width):
    found = neardup.groups(docs, width).collect()
    want = brute_groups(rows, width, 80)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert {r.doc_id: r.n_shingles for r in found}[5] == 0
    assert found and neardup.groups(docs.limit(0), width).count() == 0


def test_groups_of_chains_and_crowds(spark):
    """Near copies of near copies, many copies of one text, and one id with two texts."""
    rnd = random.Random(5)
    rows, text = [], [f"w{rnd.randrange(5000)}" for _ in range(80)]
    for i in range(40):
        rows.append((100 + i, " ".join(text)))
        text[rnd.randrange(80)] = f"n{i}"
    rows += [(500 + i, "same words in every one of these rows") for i in range(30)]
    crowd = [f"c{j}" for j in range(60)]
    for i in range(40):  # alike, but by less than the share
        own = [w if rnd.random() < 0.85 else f"x{i}-{j}" for j, w in enumerate(crowd)]
        rows.append((700 + i, " ".join(own)))
    rows += [(900, rows[0][1]), (900, "same words in every one of these rows")]
    found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(rows, 2, 80)


@pytest.mark.parametrize("crowd", [2048, 9])
def test_a_crowd_that_is_alike_by_less_than_the_share(spark, monkeypatch, crowd):
    """Members alike by 0.5 to 0.9 that meet in most tables, some of them linked, in blocks and in one group."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "CHUNK", 3000)
    rnd = random.Random(crowd)
    base = [f"c{j}" for j in range(90)]
    rows = []
    for i in range(90):
        share = rnd.choice([0.86, 0.9, 0.94, 0.97])
        rows.append((i, " ".join(w if rnd.random() < share else f"x{rnd.randrange(400)}" for w in base)))
    rows += [(200 + i, rows[i][1] + " and a tail of its own") for i in range(5)] + [(300, rows[3][1]), (300, rows[40][1])]
    found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    want = brute_groups(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in found} == want and 20 < len(set(want.values())) < 90


def test_sketches_in_matrices_equal_single_ones():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 3000, n).astype(np.uint64)) for n in (3, 30, 40, 70, 400, 420, 900)]
    flat, sizes = neardup.sketches(np.concatenate(sets), np.array([*map(len, sets)]))
    made = [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    x, y = (a.ravel() for a in np.meshgrid(np.arange(7), np.arange(7)))
    gaps = np.array([neardup.apart(made[a], made[b]) for a, b in zip(x, y, strict=True)])
    for most in (gaps, gaps - 1, np.full(49, 100)):
        assert (neardup.passing(made, made, x, y, most) == (gaps <= most)).all()


def test_sketches_never_overstate_the_difference():
    draw = np.random.default_rng(4)
    sets = [draw.integers(0, 6000, n).astype(np.uint64) for n in (1, 2, 30, 33, 400, 500, 600, 5000, 9000)]
    sets = [np.unique(x) for x in sets] + [np.arange(20_000, dtype=np.uint64)]
    counts = np.array([0, *map(len, sets)])
    flat, sizes = neardup.sketches(np.concatenate(sets), counts)
    made = [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert made[0] == b"" and max(sizes) == neardup.MOST_CELLS
    for x, a in zip(sets, made[1:], strict=True):
        for y, b in zip(sets, made[1:], strict=True):
            assert neardup.apart(a, b) <= len(np.setxor1d(x, y))
            if len(a) == len(b):
                assert neardup.apart(a, b) >= abs(len(x) - len(y))
    hot = np.full((1, 32), 200, np.uint8).tobytes()  # cells that fold stop counting as well
    assert neardup.apart(hot * 2, np.full(32, neardup.FULL, np.uint8).tobytes()) == 0


def brute_passages(rows, width):
    first, out = {}, []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in order:
        words = (t or "").encode().split()
        for s in range(len(words) - width + 1):
            key = tuple(words[s: s + width])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            if i is not None and first[tuple(words[s: s + width])] != (i, s):
                gone[s: s + width] = [True] * width
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("width", [20, 5])
def test_passages_equal_brute_force(docs, nothing, rows, width):
    found = passages.remove(docs, width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_passages(rows, width)
    assert all(r["row"].n_words == "a" for r in found)
    assert passages.remove(nothing, width).count() == 0


@pytest.mark.parametrize("block", [10, 500_000])
def test_passages_of_an_id_with_several_texts(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    a, t = (" ".join(f"{x}{i}" for i in range(40)) for x in "at")
    for rows in ([(1, a), (2, a), (2, t)], [(1, a), (2, a), (2, t), (3, t + " tail")], [(2, a), (2, t), (2, a + " " + t), (1, "x " + a)]):
        rows = rows + [(None, a)] * 3
        found = passages.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_passages(rows, 20)


def test_passages_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 300)
    rnd = random.Random(9)
    shared = [[f"s{k}-{rnd.randrange(300)}" for _ in range(rnd.randint(19, 60))] for k in range(8)]
    rows = []
    for i in range(60):
        words = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            part = rnd.choice(shared)
            cut = rnd.randint(0, 5)
            words[rnd.randint(0, len(words)):0] = part[cut:]
        rows.append((i, " ".join(words)))
    found = passages.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_passages(rows, 20)


def test_words_of_passages_are_ranges_of_bytes():
    """Words, their hashes and joined texts of odd columns: nulls, slices, chunks, zero bytes, white space beyond ASCII."""
    rng = random.Random(1)
    bits = ["a", "b", "\0", " ", "  ", "\t", "\x0b", "\x1c", "\x85", "é", "😀", "word", "longerword", "x" * 17]
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(rng.randrange(6))]
        column = pa.array(["cut off", *texts], pa.string()).slice(1)
        if rng.random() < 0.5:
            column = pa.chunked_array([column.slice(0, 2), column.slice(2)], pa.string())
        found = passages.Words(column)
        parts = [(t or "").encode().split() for t in texts]
        flat = [w for p in parts for w in p]
        assert found.sizes.tolist() == [len(p) for p in parts]
        assert [found.data[a:b].tobytes() for a, b in zip(found.begin, found.end, strict=True)] == flat
        with np.errstate(over="ignore"):
            assert len(set(zip(flat, found.hashes().tolist(), strict=True))) == len(set(flat)) == len(set(found.hashes().tolist()))
        keep = np.array([rng.random() < 0.6 for _ in flat], bool)
        left = iter(keep)
        assert found.joined(keep).to_pylist() == [b" ".join(w for w in p if next(left)).decode() for p in parts]


def test_half_keys_do_not_depend_on_what_a_cache_holds(monkeypatch):
    texts = [f"{i % 7} common words and own ones {i} " * (i % 5) for i in range(60)]
    with np.errstate(over="ignore"):
        flat, counts = neardup.sets_of(texts, 2)
        want = neardup.half_keys(flat, counts)
        for most in (1, 5, 40):
            monkeypatch.setattr(neardup, "CACHED", most)
            assert (neardup.half_keys(flat, counts) == want).all()
    assert want.shape == ((counts > 0).sum(), 2 * neardup.SIDE) and len({tuple(k) for k in want}) > 1
    hashes = [xxhash.xxh3_64_intdigest(w) for w in (b"a", b"b", b"a")]
    assert word_hashes([[b"a"], [], [b"b", b"a"]]).tolist() == hashes
