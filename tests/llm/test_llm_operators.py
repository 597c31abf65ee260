"""The operators and thin queries over small awkward tables and over the smallest test tables, against brute force and SQL."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gallerist.llm import bpe, line_dedup, near_dedup, packing, ppm_scoring, quality_rules, suffix_dedup, tiff, token_counts, toxicity
from gallerist.llm._common import id_fold

from ppm_definition import Model

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
smallest = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(7)
WORDS = ["".join(rnd.choice("abcdeimnorst") for _ in range(rnd.randint(1, 7))) for _ in range(300)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(1, 120)
TEXTS = [
    None, "", " \n\t ", "one", "one two three", PASSAGE, PASSAGE, PASSAGE + " more", prose(2, 40) + PASSAGE + prose(3, 40), "x" * 1500, "ab" * 700, prose(4, 3000), prose(5, 90),
    "a\nb\nc\nd\n", "q\na\nb\nc\nz", "a\nb\nc\na\nb\nc", "\n\n\n\n", "é" * 450, "Ünïcode " * 80, "#$%&* " * 60, "the of and to " * 30, PASSAGE.replace(" ", "  ").upper(),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, rows twice, and columns whose names operators might want for themselves."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[15]]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("id", "key", "quality", "quality_1", "line_dedup", "line_dedup_id", "left_id", "left_kept", "gone", "place", "row", "words.n")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, columns, key="doc_id"):
    out = {}
    for r in df.select(key, *columns).collect():
        out.setdefault(r[key], []).append(tuple(r)[1:])
    return out


def each(df, columns):
    """One value for each id; rows twice must agree."""
    found = by_id(df, columns)
    for i, values in found.items():
        assert len(values) == (2 if i in (5, 15) else 1), i
        assert len(set(values)) == 1
    return {i: v[0] for i, v in found.items()}


# --- quality rules ------------------------------------------------------------------------------------------------


def quality_of(t):
    t = t or ""
    words = [w for w in __import__("re").split("[ \t-\r]+", t) if w]
    lines = [x for x in t.split("\n") if __import__("re").search("[^ \t-\r]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(docs, empty):
    scored = quality_rules.score_documents(docs)
    name = scored.columns[-1]
    assert name not in docs.columns
    got = each(scored.select("doc_id", f"{name}.*"), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    for i, t in enumerate(TEXTS):
        want = quality_of(t)
        assert got[i][:5] == want, (i, t)
        assert got[i][5] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[i][5] and got[i][6])
    assert not got[19][6]
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in got.items() if v[6]}
    assert quality_rules.filter_documents(empty).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("ReusedExchange", "").replace("Exchange RoundRobin", "")


# --- line dedup ---------------------------------------------------------------------------------------------------


def stripped(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - n + 1):
            w = tuple(lines[k : k + n])
            if w in seen:
                gone |= set(range(k, k + n))
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_line_dedup(docs, empty, n):
    out, name = line_dedup.strip_repeated_lines(docs, min_lines=n)
    assert out.columns == [*docs.columns, name]
    got = each(out.select("doc_id", "text", f"{name}.*"), ["n_lines", "n_removed", "text"])
    assert got == stripped(dict(enumerate(TEXTS)), n)
    assert line_dedup.drop_repeated_lines(empty, min_lines=n).count() == 0


def test_line_dedup_over_many_runs(spark):
    r = random.Random(3)
    texts = {i: "\n".join(r.choice("abc") for _ in range(r.randint(0, 30))) for i in range(60)}
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], DOCS)
    for n in (2, 4):
        out, name = line_dedup.strip_repeated_lines(df, min_lines=n)
        assert {i: v[0] for i, v in by_id(out.select("doc_id", "text", f"{name}.*"), ["n_lines", "n_removed", "text"]).items()} == stripped(texts, n)


@pytest.mark.parametrize("n", [1, 3])
def test_line_suffixes_are_in_order_and_share_prefixes(spark, n):
    r = random.Random(5)
    texts = {i: "\n".join(r.choice("ab") for _ in range(r.randint(0, 40))).split("\n") for i in range(30)}
    texts[30] = texts[31] = [str(i) for i in range(50)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rounds = line_dedup.suffix_intervals(df, min_lines=n)
    assert [size for size, _ in rounds] == [n * 2**k for k in range(len(rounds))]
    before = {}
    for size, rows in rounds:
        places = _windows(texts, size)
        got, ranks = {}, {}
        for row in rows.collect():
            got.setdefault(row["rank"], set()).add((row["id"]["id"], row["at"]))
            ranks[row["id"]["id"], row["at"]] = row["rank"]
        assert sorted(map(sorted, got.values())) == sorted(sorted(p) for p in places.values() if len(p) > 1)
        pairs = [((before[p], before[p[0], p[1] + size // 2]), ranks[p]) for p in ranks] if before else []
        assert sorted(ranks[p] for p in ranks) == [x for _, x in sorted(pairs)] if pairs else True
        before = ranks
    assert not any(len(p) > 1 for p in _windows(texts, 2 * rounds[-1][0]).values())
    out, name = line_dedup.strip_repeated_lines(df, min_lines=n)
    shared = {i: v[0] for i, v in by_id(out.select("doc_id", f"{name}.*"), ["shared_lines"]).items()}
    assert shared[30] == (max(size for size, _ in rounds if size <= 50),)


def _windows(texts, size):
    out = {}
    for i, t in texts.items():
        for k in range(len(t) - size + 1):
            out.setdefault(tuple(t[k : k + size]), set()).add((i, k))
    return out


def test_line_dedup_of_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "x\ny\na\nb\nc"), (2, "a\nb\nc\nd"), (1, "a\nb\nc")], "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in line_dedup.strip_repeated_lines(df)[0].collect())
    assert out in ([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\ny"), (2, "d")], [(1, ""), (1, ""), (1, "x\ny\na\nb\nc"), (2, "d")])


def test_line_dedup_keeps_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a\nb\nc", "", "", 0), (1, "a\nb\nc", "", "", 0), (2, "a\nb\nc", "", "", 0)], DOCS)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.drop_repeated_lines(df).collect()) == [(-1, "a\nb\nc"), (1, "a\nb\nc")]


# --- repeated passages --------------------------------------------------------------------------------------------


def passages_of(rows, length):
    """rows: (id, text), repeated rows included."""
    counts = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        counts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), len(b) - len(rest), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("length, anchor, hot", [(400, 200, 1000), (400, 200, 0), (60, 20, 1000), (60, 20, 2)])
def test_suffix_dedup(docs, empty, length, anchor, hot):
    got = each(suffix_dedup.remove_repeats(docs, length=length, anchor=anchor, hot=hot), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == passages_of([*enumerate(TEXTS), (5, TEXTS[5]), (15, TEXTS[15])], length)
    assert suffix_dedup.remove_repeats(empty, length=length, anchor=anchor).count() == 0


def passage_words_of(texts, n):
    """How many words of each text are covered by runs of n words that stand in two places."""
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if counts[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("hot", [1000, 0])
def test_passages_of_300_and_of_450_bytes(spark, hot):
    """What removal by 400 bytes leaves, the count of words tells; ids may be missing or stand for several texts."""
    r = random.Random(31)
    shorter, longer, few = (" ".join(r.choice(WORDS) for _ in range(n)) for n in (66, 100, 50))
    assert len(shorter) < 390 and len(longer) > 450
    texts = [f"{prose(600 + i, 30)} {p} {prose(700 + i, 30)}" for i, p in enumerate([shorter, shorter.replace(" ", "\n"), longer, longer, few, few])]
    ids = [1, None, 1, None, 4, 5]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(df, hot=hot).select("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "doc_id").collect())
    gone = passages_of(list(enumerate(texts)), 400)
    want = sorted((*gone[i], w, ids[i]) for i, w in enumerate(passage_words_of(texts, 51)))
    assert got == want and [g[1] > 0 for g in gone.values()] == [False, False, True, True, False, False]
    assert [w > 50 for w in passage_words_of(texts, 51)] == [True] * 4 + [False] * 2
    left = sorted(x["text"] for x in suffix_dedup.strip_passages(df, hot=hot).collect())
    # bytes before a passage that happen to agree go with it, so a word of one letter may
    assert len(left) == 6 and all(len(x.split()) in ((110,) if x in texts[4:] else (59, 60)) for x in left)


def test_strip_repeats(docs):
    out = suffix_dedup.strip_repeats(docs)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert 5 not in ids and 6 not in ids and ids[15] == 2 and ids[0] == 1 and ids[1] == 1


@pytest.mark.parametrize("hot", [1000, 0])
def test_pipeline_strips_passages_of_51_words(spark, hot):
    import corpus_pipeline

    r = random.Random(21)
    short, longer = (" ".join(r.choice("abcdefghij") for _ in range(n)) for n in (51, 60))
    spaced, few = prose(22, 51), prose(23, 50)
    texts = {i: (prose(100 + i, 40), p, prose(200 + i, 40)) for i, p in enumerate([short, short, few, few, spaced, spaced.replace(" ", "\n"), longer, longer])}
    assert len(short) == 101
    df = spark.createDataFrame([(i, " ".join(t), "", "", 0) for i, t in texts.items()] + [(8, short + "\n", "", "", 0), (9, None, "", "", 0), (10, few, "", "", 0)], DOCS)
    stage = corpus_pipeline.passages(spark, df, "") if hot else suffix_dedup.strip_passages(df, hot=0)
    got = {x["doc_id"]: (x["text"] or "").split() for x in stage.collect()}
    want = {i: (f"{a} {z}" if i not in (2, 3) else f"{a} {p} {z}").split() for i, (a, p, z) in texts.items()}
    assert got == want | {9: [], 10: few.split()}


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    texts = [[np.frombuffer(t, np.uint8)] for t in [prose(11, 400).encode() + b"#" + prose(12, 80).encode(), prose(12, 80).encode() * 3]]
    texts += [[suffix_dedup.word_places(prose(11, 2000).encode())[0]]]
    for t in texts:
        found = {}
        for _, shift, part in suffix_dedup.blocks(t, 60):
            w = suffix_dedup.Windows(part, 60, 20)
            _, key, first, count = w.segments()
            for k, f, n in zip(key.tolist(), first.tolist(), count.tolist(), strict=True):
                found |= {f + shift + x: k for x in range(n)}
        whole = suffix_dedup.Windows(t, 60, 20)
        assert found == dict(enumerate(whole.bucket.tolist()))


# --- near duplicates ----------------------------------------------------------------------------------------------


def classes_of(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    return {i: (len(sets[i]), parent[i], parent[i] == i) for i in sets}


def test_near_duplicates(docs, empty):
    got = each(near_dedup.near_duplicates(docs, width=4), ["n_shingles", "component_id", "kept"])
    assert got == classes_of(dict(enumerate(TEXTS)), 4, 80)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in classes_of(dict(enumerate(TEXTS)), 5, 80).items() if v[2]}


def test_near_duplicates_in_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r, base = random.Random(9), [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(70):
        words = base.copy()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"v{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], DOCS)
    got = {i: v[0] for i, v in by_id(near_dedup.near_duplicates(df, width=5), ["n_shingles", "component_id", "kept"]).items()}
    assert got == classes_of(texts, 5, 80)


def test_null_ids_have_no_component(spark):
    df = spark.createDataFrame([(None, PASSAGE, "", "", 0), (4, PASSAGE, "", "", 0)], DOCS)
    assert sorted(((r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=str) == [(4, True), (None, False)]
    assert near_dedup.keep_one_of_each(df).count() == 2


# --- tokens -------------------------------------------------------------------------------------------------------


def test_byte_bpe(docs, empty):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_documents(docs, path, public.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=bpe.ByteBPE.from_file(path).ranks, special_tokens={})
    got = each(out.withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>"))), ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), ",".join(map(str, ids)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode_documents(empty, path, public.PATTERN).count() == 0


def test_token_counts(docs, empty):
    import base64

    import regex

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        trie = token_counts.UnigramTrie(token_counts.zipf_scores({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))
    got = each(token_counts.count_tokens(docs, path, public.PATTERN), ["n_pretokens", "n_tokens", "log_score"])
    for i, t in enumerate(TEXTS):
        pieces = regex.findall(public.PATTERN, t or "")
        found = [trie.one(p.encode()) for p in pieces]
        assert got[i][:2] == (len(pieces), sum(n for _, n in found)) and got[i][2] == pytest.approx(sum(s for s, _ in found) / 1e6)
    assert token_counts.count_tokens(empty, path, public.PATTERN).count() == 0


def pieces_of(texts, capacity=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = []
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out)


def packed_well(rows, capacity=1024):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


@pytest.mark.parametrize("dealt", [100_000, 10])
def test_packing(docs, empty, dealt):
    path = public.path("byte_bpe_50k.tiktoken")
    marked = [(100, "a <|endoftext|> b"), (101, "<|endoftext|><|endoftext|>\n <|endoftext|"), (102, "x  <|endoftext|>  y"), (102, "another text")]
    more = docs.sparkSession.createDataFrame(marked, "doc_id long, text string")
    added = packing.added_tokens(public.path("byte_bpe_50k.json"))
    pieces = packing.token_pieces(docs.select("doc_id", "text").union(more), path, public.PATTERN, 2, 1024, added=added)
    rows = packing.pack(pieces, 1024, dealt).collect()
    assert sorted((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces_of([*enumerate(TEXTS), (5, TEXTS[5]), (15, TEXTS[15]), *marked])
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 1024)
    assert bound <= packed_well(rows) <= bound + (1 if dealt > 10 else 3)
    assert packing.pack_documents(empty, path, public.PATTERN).count() == 0
    null_id = docs.sparkSession.createDataFrame([(None, "one text"), (None, None)], "doc_id long, text string")
    assert sorted(r["length"] for r in packing.pack_documents(null_id, path, public.PATTERN).where("doc_id IS NULL").collect()) == [1, 3]


# --- media --------------------------------------------------------------------------------------------------------


def test_media(docs, empty):
    media = tiff.media_documents(docs)
    got = each(tiff.digest_pages(media), ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
    files = {i: v[0][0] for i, v in by_id(media, ["media"]).items()}
    for i, t in enumerate(TEXTS):
        p = tiff.payload_of(t or "")
        assert got[i][:4] == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert got[i][4:6] == (len(files[i]), hashlib.sha256(files[i]).hexdigest()) and got[i][6].startswith(f"pages={-(-len(p) // (192 * 64))} ")
    pages = tiff.tiff_pages(media, "doc_id", "media")
    assert {r["doc_id"]: r["n"] for r in pages.where("doc_id = 11").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {11: -(-len(tiff.payload_of(TEXTS[11])) // (192 * 64))}
    broken = pages.sparkSession.createDataFrame([(1, bytearray(b"no")), (2, None)], "id long, content binary")
    assert [r["error"] for r in tiff.tiff_pages(broken, "id", "content").orderBy("id").collect()] == ["no TIFF header"] * 2
    assert tiff.digest_pages(tiff.media_documents(empty)).count() == 0


# --- scores -------------------------------------------------------------------------------------------------------


def test_ppm(docs, empty):
    held_out = id_fold("id", 7) == 2
    learnt = [(t or "").encode().lower() for i, t in [*enumerate(TEXTS), (5, TEXTS[5]), (15, TEXTS[15])] if zlib.crc32(str(i).encode()) % 7 != 2]
    model = Model(learnt, ppm_scoring.ORDER)
    for most in (1 << 19, 3):  # with few words looked up in place, the join gives the rest
        got = each(ppm_scoring.score(docs, held_out, max_words=most, max_grams=10 * most), ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(TEXTS)}
        out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
        counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws * (2 if i in (5, 15) else 1))
        total, distinct = sum(counts.values()), len(counts)
        for i, ws in tokens.items():
            assert got[i][:4] == (out[i], len(ws), sum(counts[w] > 0 for w in ws), total)
            assert got[i][4] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
            assert got[i][5] == pytest.approx(model.score((TEXTS[i] or "").encode().lower()), rel=1e-5)
    assert ppm_scoring.score(empty, held_out).count() == 0
    assert ppm_scoring.score(docs.where("doc_id = -1").union(docs.where("doc_id = 12")), F.lit(True)).first()["n_known"] == 0


def test_ppm_keeps_all_contexts(spark, monkeypatch):
    """More contexts than any fixed table, a few rows at a time, and texts without an id or with one that others have."""
    r = random.Random(8)
    texts = {i: "".join(r.choice("abcdefghijklmnopqrstuvwxyz 0123456789") for _ in range(2000)) for i in range(40)}
    model = Model([t.encode() for t in texts.values()], ppm_scoring.ORDER)
    assert len(model.symbols[ppm_scoring.ORDER]) > 65_536
    want = sorted(model.score(t.encode()) for t in texts.values())
    df = spark.createDataFrame([(None if i < 2 else i % 20, t, "", "", 0) for i, t in texts.items()], DOCS)
    for most in (1 << 20, 50):  # with few strings looked up in place, the join gives the rest
        got = [x["score"] for x in ppm_scoring.score(df, F.lit(False), max_grams=most).collect()]
        assert sorted(got) == pytest.approx(want, rel=1e-5)
        grams = spark.createDataFrame([(1, 1, 1)], "key long, n long, places long")
        assert ppm_scoring.coded(grams.limit(0)).count() == 0


def test_ppm_codes_in_small_groups(spark):
    learnt = [prose(80 + i, 60).encode() for i in range(5)]
    key, n = np.unique(ppm_scoring._grams(learnt, 6)[0], return_counts=True)
    grams = spark.createDataFrame([(int(k), int(c), int(c)) for k, c in zip(key, n, strict=True)], "key long, n long, places long")
    one, many = ({r["key"]: r["log_p"] for r in ppm_scoring.coded(grams, at_once=size).collect()} for size in (1, 10**6))
    assert one == pytest.approx(many) and len(one) == len(key)


@smallest
def test_op6_tells_more_than_the_words(spark):
    """Bits a byte on held-out rows: near those of the add-one word model, which needs no code for words it never met."""
    rows = [r for r in entry.queries()["op6_ppm_scoring"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).collect()]
    assert rows[0][0] > rows[0][1] * 0.95


def test_toxicity(spark, docs):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [r.choice(WORDS) for _ in range(40)]
        for _ in range(3 if bad else 0):
            words[r.randrange(40)] = r.choice(["vexu", "zorka"]) + r.choice(["n", "st", "lo", "mi"])
        rows.append((i, " ".join(words), "", "", 0))
        labels.append((i, 1, int(bad)))
    rows += [(600, None, "", "", 0), (601, "", "", "", 0), (602, "You stupid pathetic moron!", "", "", 0)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    held_out = id_fold("id", 4) == 2
    found = {x["doc_id"]: x for x in toxicity.score(df, lab, held_out).collect()}
    assert len(found) == 603 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in found.values())
    out = [i for i in range(600) if found[i]["held_out"]]
    assert out == [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i]["predicted"] == (i % 5 == 0) for i in out]) > 0.97
    # labels of held-out rows change nothing
    turned = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x["doc_id"]: x["score"] for x in toxicity.score(df, turned, held_out).collect()}
    assert again == pytest.approx({i: x["score"] for i, x in found.items()})
    # without labels the seed lexicons stand in
    bare = {x["doc_id"]: x["score"] for x in toxicity.score(df, lab.limit(0), held_out).collect()}
    assert bare[602] > 0.9 > 0.3 > bare[1] and bare[600] == bare[601]
    assert toxicity.score(df.limit(0), lab, held_out).count() == 0
    assert toxicity.score(docs, lab, held_out).count() == len(TEXTS) + 2


def test_toxicity_learns_from_documents_without_a_label(spark):
    """Few labels name one half of the bad words; the other half stands beside them in unlabelled documents alone."""
    r = random.Random(6)
    known_bad, other_bad = ["vexuna", "zorkast", "plimmor"], ["quabbel", "drostig", "fennwak"]
    rows, labels = [], []
    for i in range(1500):
        bad, words = i % 5 == 0, [r.choice(WORDS) for _ in range(30)]
        if bad:
            pool = known_bad if i < 300 else other_bad if i >= 1300 else known_bad + other_bad
            for _ in range(5):
                words[r.randrange(30)] = r.choice(pool)
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "id long, text string")
    lab = spark.createDataFrame(labels, "id long, toxic int")
    test = [t for i, t in rows if i >= 1300]
    found = {}
    for most in (20_000, 0):  # without unlabelled rows nothing comes through the label model but the labels
        _, model, classifier = toxicity.train(docs, lab, F.col("id") < 1300, max_unlabelled=most)
        s = classifier.scores(test) >= 0.3
        found[most] = (int(s[::5].sum()), int(s.sum() - s[::5].sum()))
    assert found[20_000][0] >= 12 and found[20_000][1] <= 4 and found[0][0] <= 2, found


def test_toxicity_of_rows_without_an_id_or_with_one_twice(spark):
    bad, good = "you stupid vexuna zorkast " * 5, "the calm garden " * 8
    rows = [(None, bad), (None, good), (1, bad), (1, good), (1, good), (2, None)] + [(10 + i, f"{bad if i % 3 == 0 else good} {prose(i, 20)}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("toxic", F.lit(0))
    lab = spark.createDataFrame([(10 + i, int(i % 3 == 0)) for i in range(90)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, lab, F.lit(False)).collect()
    assert len(got) == 96 and sorted((r["predicted"] for r in got if r["doc_id"] in (None, 1))) == [0, 0, 0, 1, 1]


# --- queries ------------------------------------------------------------------------------------------------------


@smallest
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    records = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[c] for c in columns) for r in records)


@smallest
@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k.startswith("op") and k not in entry.oracle_sql()))
def test_query_has_a_row_for_each_document(spark, name):
    rows = entry.queries()[name](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert rows.select("doc_id").distinct().count() == ids.count() == rows.select("doc_id").intersect(ids).count()


@smallest
def test_op3_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in entry.queries()["op3_suffix_dedup"](spark, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == passages_of(rows, 400)
    words = {r["doc_id"]: r["n_passage_words"] for r in entry.queries()["op3_suffix_dedup"](spark, SF).collect()}
    assert words == dict(zip([i for i, _ in rows], passage_words_of([t for _, t in rows], 51), strict=True))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    stop = ["the", "of", "and", "to", "in"]

    def text(seed, n):
        words = random.Random(seed)
        return " ".join(words.choice(stop if k % 4 == 0 else WORDS) for k in range(n))

    lines = lambda seed, n, k: "\n".join(text(f"{seed}-{j}", n) for j in range(k))
    shared = text("shared", 110)
    texts = {i: lines(i, 25, 5) for i in range(30)}
    texts |= {30: texts[3], 31: texts[4] + " tail", 32: lines(32, 20, 2) + "\n" + texts[6], 33: text(33, 70) + " " + shared + " " + text(34, 70), 34: text(35, 70) + " " + shared + " " + text(36, 70), 35: "short", 36: None, 37: text(37, 3000), 38: shared}
    rows = [(i, t, "en", f"s{r.randint(0, 2)}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))

    kept = {}
    for i, t in texts.items():
        n, _, _, dup, rep = quality_of(t)
        if n >= 50 and 100 * rep <= 50 * n:
            kept[i] = t
    kept = {i: v[2] for i, v in stripped(kept, line_dedup.MIN_LINES).items() if v[1] < v[0]}
    kept = {i: t for i, t in kept.items() if classes_of(kept, 5, 80)[i][2]}
    counts = Counter(t.encode()[k : k + 400] for t in kept.values() for k in range(len(t.encode()) - 399))
    final = {}
    for i, t in kept.items():
        b = t.encode()
        gone = np.zeros(len(b) + 400, bool)
        for k in range(len(b) - 399):
            if counts[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g).decode()
        if rest:
            final[i] = rest
    assert set(range(30)) - {4} <= set(final) | {3} and 30 not in final and 35 not in final and 38 not in final
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces_of(sorted(final.items()))
    packed_well(got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").count() == 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_hot_keys(spark):
    """One line, and one text, with far more rows than any share that is joined by key."""
    texts = {0: "\n".join(["same"] * 2500), 1: "same\nother\nsame\nsame\nsame", 2: "x\ny\nz"}
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], DOCS)
    out, name = line_dedup.strip_repeated_lines(df)
    assert {i: v[0] for i, v in by_id(out.select("doc_id", "text", f"{name}.*"), ["n_lines", "n_removed", "text"]).items()} == stripped(texts, 3)
    many = spark.range(5, 1505).select(F.col("id").alias("doc_id"), F.lit(PASSAGE).alias("text")).union(spark.createDataFrame([(1, prose(50, 30)), (2, PASSAGE), (3, None)], "doc_id long, text string"))
    found = near_dedup.near_duplicates(many).groupBy("component_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 1), (2, 1501, 1), (3, 1, 1)]
