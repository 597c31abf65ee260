"""The numeric cores of the operators against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gallerist.llm import bpe, near_dedup, packing, ppm_scoring, suffix_dedup, tiff, token_counts, toxicity
from gallerist.llm.shingles import lowered, shingle_sets, word_hashes
from gallerist.llm.suffix_sort import common_prefixes, two_stage_suffix_array

from ppm_definition import Model

public = pytest.importorskip("public_tokenizers")


def random_texts(seed, n, alphabet="abc dé\n", longest=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(200):
        parts = [bytes(rnd.choice(b"ab\xffc"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 5))]
        order, s = two_stage_suffix_array([np.frombuffer(p, np.uint8) for p in parts], 1000)
        symbols = s.tolist()
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        for a, b, n in zip(order[:-1], order[1:], common_prefixes(s, order[:-1], order[1:], 13), strict=True):
            k = 0
            while k < 13 and max(a, b) + k < len(symbols) and symbols[a + k] == symbols[b + k]:
                k += 1
            assert k == n


@pytest.mark.parametrize("numbers", [[97, 98, 255, 99], [7, 1 << 63, 300, 5], list(range(0, 1 << 40, 1 << 24)), None])
def test_repeated_windows(numbers):
    rnd = random.Random(4)
    kind = np.uint8 if numbers and max(numbers) < 256 else np.uint64
    for _ in range(100 if numbers else 2):
        parts = [tuple(rnd.choice((numbers or [1, 2])[: rnd.choice((1, 2, 4, 1 << 17))]) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 5))]
        parts += [parts[0][1:9] + parts[-1][2:7]]
        if not numbers:  # more of them than two bytes tell apart
            parts.append(tuple(rnd.getrandbits(64) for _ in range(70_000)))
        length = rnd.randint(2, 8)
        counts = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, found in zip(parts, suffix_dedup.repeated_windows([np.array(p, kind) for p in parts], length), strict=True):
            assert found.tolist() == [i for i in range(len(p) - length + 1) if counts[p[i : i + length]] > 1]


def test_rolling_hash_follows_the_bytes():
    x = np.random.default_rng(0).integers(0, 256, 900).astype(np.uint8)
    for width in (1, 2, 3, 200, 399, 400):
        h = suffix_dedup.rolling(np.concatenate([x[:50], x]), width)
        assert len(h) == 951 - width and (h[50:] == suffix_dedup.rolling(x, width)).all()


def test_shingles():
    for width in (1, 4, 5):
        texts = [lowered(t) for t in random_texts(width, 50)] + [b"", b" \t\n", b"One", b"one two"]
        hashes, counts = shingle_sets(texts, width)
        seen, at = {}, 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            words = t.split()
            want = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
            assert n == len(want)
            for h in hashes[at : at + n].tolist():
                seen.setdefault(h, set()).add(t)
            at += n
    words, starts = word_hashes(b" ab\tcd ab\x0b")
    assert starts.tolist() == [1, 4, 7] and words[0] == words[2] != words[1]
    assert len(word_hashes(b"")[0]) == 0


def test_sketch_estimates_jaccard():
    rng, sketch = np.random.default_rng(5), near_dedup.Sketch(registers=512)
    for share in (0.2, 0.5, 0.8, 1.0):
        universe = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        both = int(2000 * 2 * share / (1 + share))
        a, b = universe[:2000], universe[2000 - both : 4000 - both]
        regs = sketch.of_sets(np.concatenate([np.sort(a), np.sort(b)]), np.array([2000, 2000])).astype(int)
        got = sketch.likely_jaccard(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([2000.0]), np.array([2000.0]))[0]
        assert got == pytest.approx(share, abs=0.08)
        union = sketch.of_sets(np.unique(np.concatenate([a, b])), np.array([len(np.unique(np.concatenate([a, b])))]))
        assert (union[0] == regs.max(axis=0)).all()  # registers merge by maximum
    assert (sketch.of_sets(np.zeros(0, np.uint64), np.array([0])) == 0).all()


def test_spanning_links():
    rng = np.random.default_rng(2)
    for trial in range(40):
        base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.integers(0, 1 << 62, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(12)]
        n = len(sets)
        linked = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

        def groups(edges):
            g = list(range(n))
            for _ in range(n):
                for a, b in edges:
                    g[a] = g[b] = min(g[a], g[b])
            return g

        got = near_dedup.spanning_links(np.arange(n), np.arange(n), np.concatenate(sets), np.array([len(s) for s in sets]), 80)
        assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in linked} and len(got) < n
        assert groups(got) == groups(linked)


def test_spanning_links_of_chains():
    rng = np.random.default_rng(6)
    for _ in range(150):
        words, sets = list(range(60)), []
        for _ in range(30):  # each an edited copy of the one before
            words = words.copy()
            for _ in range(rng.integers(1, 7)):
                words[rng.integers(len(words))] = int(rng.integers(1, 1 << 40))
            sets.append(np.unique(np.array(words[: rng.integers(50, 61)], np.uint64)))
        n = len(sets)
        labels = rng.permutation(n)
        start = [(i, int(rng.integers(n))) for i in range(0, n, 4)] if rng.integers(2) else []
        linked = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

        def groups(edges):
            g = np.arange(n)
            for a, b in edges:
                g[g == max(g[a], g[b])] = min(g[a], g[b])
            return g.tolist()

        components = labels[np.array(groups(start))]
        got = near_dedup.spanning_links(np.arange(n), components, np.concatenate(sets), np.array([len(s) for s in sets]), 80)
        assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in linked}
        assert groups(start + got) == groups(start + linked)


@pytest.fixture(scope="module")
def multi():
    return bpe.ByteBPE.from_file(public.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_as_the_library(multi):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=multi.ranks, special_tokens={})
    _, coder = bpe.ByteBPE, bpe.PieceCoder(public.PATTERN, multi.encode_pieces, max_pieces=50)
    texts = random_texts(1, 300, "aabbccdé the ing'strn \n\t漢字🙂  ", 300) + ["", "a" * 9000, "ab" * 5000, "é" * 3000, "<|endoftext|>", "x\x1cy\x85z​\xa0 q", " " * 500]
    for part in (texts[:150], texts[150:]):  # pieces are forgotten in between
        for t, ids in zip(part, coder.encode_texts(part), strict=True):
            assert ids.tolist() == library.encode_ordinary(t)
            assert multi.decode(ids) == t.encode()


def test_long_pieces_as_short_ones(multi):
    rnd = random.Random(4)
    for _ in range(30):
        raw = bytes(rnd.choice(b"abcdeth n") for _ in range(rnd.randint(2, 400)))
        assert multi.encode_long(raw) == multi.encode_many([raw, b"zz"])[0].tolist()[: len(multi.encode_long(raw))]


def test_bitmap():
    rnd, bitmap, held = random.Random(0), bpe.RankBitmap(), set()
    for _ in range(3000):
        r = rnd.randrange(200_000)
        if rnd.random() < 0.5 and held:
            r = rnd.choice(sorted(held)) if rnd.random() < 0.1 else min(held)
            held.discard(r)
            bitmap.discard(r)
        else:
            held.add(r)
            bitmap.add(r)
        assert bitmap.first() == (min(held) if held else -1)


def test_unigram_trie():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        trie = token_counts.UnigramTrie(token_counts.zipf_scores({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))
    rnd = random.Random(1)
    raw = list({"".join(rnd.choice("abthe inré  ") for _ in range(rnd.randint(1, 30))).encode() for _ in range(400)} | {b" " * n for n in range(1, 200)} | {b"", b"a" * 300})
    scores, counts = trie.many(raw)
    for r, s, n in zip(raw, scores.tolist(), counts.tolist(), strict=True):
        assert (s, n) == trie.one(r)

    def best(r):
        found = [0]
        for cuts in range(1 << (len(r) - 1)):
            at = [0, *(i + 1 for i in range(len(r) - 1) if cuts >> i & 1), len(r)]
            pieces = [trie.scores.get(r[a:b]) for a, b in zip(at, at[1:], strict=False)]
            if None not in pieces:
                found.append(sum(pieces))
        return max(found[1:])

    for r in [x for x in raw if 0 < len(x) <= 9][:60]:
        assert trie.one(r)[0] == best(r)


@pytest.mark.parametrize("order", [2, 3, 6])
def test_code_lengths_against_the_definition(order):
    learnt, others = ([lowered(t) for t in random_texts(seed, 40, "abcd é\n")] for seed in (3, 4))
    learnt += learnt[:5] * 3
    others += [b"zz\x01ab", b""]
    grams, starts = ppm_scoring._grams(learnt, order)
    padded = [b"\xff" * order + t + b"\xff" for t in learnt]
    assert grams.tolist() == [int.from_bytes(d[i : i + order + 1], "big") for d in padded for i in range(len(d) - order)]
    key, n = np.unique(grams, return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    triples = np.unique(key & np.uint64(0xFFFFFF)).astype(np.int64)
    np.add.at(pairs, (triples >> 8 & 255, triples & 255), 1)
    context = int(key[len(key) // 2]) >> 8 << 8  # all bytes after one context
    every = np.unique(np.concatenate([key, ppm_scoring._grams(others, order)[0], np.arange(context, context + 256, dtype=np.uint64)]))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, key)] = n
    codes = ppm_scoring.code_lengths(every, counts, pairs, order)
    at = np.searchsorted(every, np.uint64(context))
    assert (10 ** codes[at : at + 256]).sum() == pytest.approx(1)
    model = Model(learnt, order)
    for t in learnt + others:
        got = codes[np.searchsorted(every, ppm_scoring._grams([t], order)[0])].sum()
        assert got == pytest.approx(model.score(t))
    assert ppm_scoring.code_lengths(every, counts * 0, pairs * 0, order) == pytest.approx(np.full(len(every), -math.log10(256)))


def test_packing():
    rng = np.random.default_rng(0)
    for n in (1, 5, 300):
        lengths = rng.integers(1, 101, n)
        bins, places = packing.best_fit_decreasing(lengths, 100)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and packing.lower_bound(lengths, 100) <= len(fill) <= 1.3 * packing.lower_bound(lengths, 100) + 1
        for b in range(len(fill)):
            spans = sorted((p, p + x) for p, x in zip(places[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert packing.lower_bound(np.array([60] * 7), 100) == 7  # certified although the sum asks for 5
    assert packing.lower_bound(np.array([34] * 7), 100) == 4


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.DEFLATE_OLD, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, order):
    rng = np.random.default_rng(compression)
    pages = []
    for kind in (np.uint8, np.uint16):
        for predictor in (1, 2):
            for layout in ({"rows_per_strip": 5}, {"tile": (16, 16)}, {}):
                a = rng.integers(0, 4 if rng.random() < 0.5 else np.iinfo(kind).max + 1, (rng.integers(1, 40), rng.integers(1, 40), rng.choice([1, 3]))).astype(kind)
                pages.append(tiff.Page(a, compression, predictor, **layout))
    data = tiff.write_tiff(pages, order)
    for page, back in zip(pages, tiff.read_tiff(data), strict=True):
        assert (page.samples == back.samples).all() and back.compression == compression


def test_codecs():
    rnd = random.Random(0)
    for n in (0, 1, 2, 127, 128, 129, 300, 20_000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            d = bytes(rnd.choice(alphabet) for _ in range(n))
            assert tiff.unpack_bits(tiff.pack_bits(d), n) == d and tiff.lzw_expand(tiff.lzw_compress(d), n) == d
    # The example of the PackBits description, and that of LZW.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_compress(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream and tiff.lzw_expand(stream, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("data", [None, b"", b"II*\0", b"II*\0\x08\0\0\0", b"II*\0\xff\xff\xff\0", b"MM\0*garbage....", tiff.store(tiff.payload_of("x" * 500))[:-40]])
def test_malformed_tiff(data):
    rows = tiff.page_rows(data)
    assert rows[-1].get("error") or (data and data[:4] == b"II*\0" and not rows)


def test_tiff_loop_and_size():
    data = bytearray(tiff.store(tiff.payload_of("x")))
    at = int.from_bytes(data[4:8], "little")
    n = int.from_bytes(data[at : at + 2], "little")
    data[at + 2 + 12 * n : at + 6 + 12 * n] = at.to_bytes(4, "little")
    assert [r["error"] for r in tiff.page_rows(bytes(data))] == [None, "directories form a loop"]
    assert tiff.page_rows(tiff.store(tiff.payload_of("x")), 10)[0]["error"] == "page too large"


def test_payload():
    for t in ("", "x", "é" * 96, "y" * 193, "z" * 50_000):
        p = tiff.payload_of(t)
        assert len(p) % 192 == 0 and p and p.rstrip(b" ") == t.encode().rstrip(b" ")
        rows = tiff.page_rows(tiff.store(p))
        assert b"".join(r["pixels"] for r in rows) == p
    assert hashlib.sha256(tiff.store(tiff.payload_of("a"))).digest() == hashlib.sha256(tiff.store(tiff.payload_of("a"))).digest()
    assert zlib.crc32(tiff.payload_of("")[-16:]) == zlib.crc32(b" " * 16)


def test_term_hashes():
    hashes, owner, kind = toxicity.term_hashes(["Moron, morons!", "", "É été"])
    words = hashes[kind == 0]
    assert owner[kind == 0].tolist() == [0, 0, 2, 2] and len(set(words.tolist())) == 4
    first = {k: hashes[(kind == k) & (owner == 0)] for k in (4, 5)}
    assert first[4][0] == first[4][1] and first[5][0] == first[5][1]
    assert len(toxicity.term_hashes([])[0]) == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    n, y = 20_000, rng.random(20_000) < 0.2
    rates = [(0.8, 0.05), (0.6, 0.02), (0.3, 0.3), (0.5, 0.1)]
    votes = np.stack([rng.random(n) < np.where(y, a, b) for a, b in rates], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a voter twice
    seen = slice(0, 2000)
    model = toxicity.LabelModel.fit(n, votes.sum(axis=0), votes.T @ votes, 2000, y[seen].sum(), (votes[seen] * y[seen, None]).sum(axis=0), votes[seen].sum(axis=0))
    assert model.toxic[:4] == pytest.approx([a for a, _ in rates], abs=0.08) and model.clean[:4] == pytest.approx([b for _, b in rates], abs=0.05)
    assert abs(model.correlation[0, 4]) > 0.2 > abs(model.correlation[0, 1]) and model.weight[4] < model.weight[1]
    p = model.posterior(votes)
    assert p[y].mean() > 0.6 > 0.2 > p[~y].mean()
    # the accuracy of labels of which one in five is wrong, and what they add
    known = np.where(rng.random(n) < 0.2, ~y, y).astype(int)
    model.judge_label(votes, known)
    assert model.label == pytest.approx(0.6, abs=0.15)
    model.judge_label(votes, y.astype(int))
    q, weight = model.judged(votes, np.where(np.arange(n) % 2, y, -1))
    assert q[1::2][y[1::2]].min() > q[0::2][y[0::2]].min() and (q[0::2] == p[0::2]).all()
    assert weight[votes.sum(axis=1) == 0][0::2].max() <= 1 and (weight[0::2][votes[0::2].sum(axis=1) == 0] == 0).all()


def test_boundary():
    toxic = np.array([1, 1, 0, 1, 0, 0, 0])
    assert toxicity.boundary(np.array([5.0, 4.0, 1.0, 3.0, 0.5, 0.4, 0.3]), toxic) == 2.0
    assert toxicity.boundary(np.array([5.0, 4.0]), np.array([1, 1])) == 4.0
    assert -1 < toxicity.boundary(np.array([2.0, 1.0, -1.0, 1.5]), np.array([1, 0, 0, 1])) < 2
