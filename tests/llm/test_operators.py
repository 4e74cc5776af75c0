"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fraudscope.llm import binary, bpe, common, decontam, katz, langid, quality, simhash, spans, suffix, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"word{i} Ünï{i % 7}" for i in range(40)) + ". Second sentence here. Third one stands, too.\n"
LONG = " ".join(f"tok{i * i % 997}" for i in range(6000)) + " " + "x" * 3000
TEXTS = [
    None, "", "   \n\t", "One two three.", "One two three.", PASSAGE, "Start. " + PASSAGE + "End it.", PASSAGE + PASSAGE, LONG, LONG + "!",
    "a" * 700, "Nd, " * 300, "<|endoftext|> It's 12 x<|endoftext|>", "日本語のテキスト。" * 30, "line\nline\nline\nother words here\n" * 3,
    "The quick brown fox jumps over the lazy dog and runs away from all the others in the big green wood today.", "\x85 　odd spaces\x1f\x1c", "🙂🙃" * 90,
]
NAMES = "doc_id long, text string, lang string, n long, row long, m long, key string, at int, chunk long, gram long, fp long, rest string, spans string, id long, hash long, score double"


def frame(spark, texts=TEXTS, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, *([1] * 3), "k", 2, *([3] * 3), "r", "s", 4, 5, 0.5) for i, t, g in zip(ids, texts, langs)], NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    """All texts, one row repeated, one id shared by two texts, one null id."""
    n = len(TEXTS)
    return frame(spark, [*TEXTS, TEXTS[5], "shared id", "null id " + PASSAGE], [*range(n), 5, 3, None])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def inputs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


# -- BPE -------------------------------------------------------------------
@pytest.mark.parametrize("leaf", [16384, 50])
def test_bpe_equals_library(docs, empty, leaf):
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in inputs(docs):
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.digests(bpe.encode_decode(docs, BYTE, leaf_chars=leaf, window=4))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)
    assert bpe.encode_decode(empty, BYTE).count() == 0


ENCODER, LIBRARY = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
PIECES = st.sampled_from(["'s", "'re", " ", "  ", "\n", "\t", "a", "the", "é", "12", "!?", "<|endoftext|>", "<|", "|>", "'", "　", "́", "🙂", "Ab"]) | st.text(max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60), st.integers(1, 9), st.integers(1, 8))
def test_tree_concatenation_is_exact(parts, leaf, window):
    text = "".join(parts).encode("utf-8", "replace").decode()
    if not text:
        return
    leaves = [(text[i: i + leaf], np.asarray(ENCODER.encode(text[i: i + leaf]), np.int32)) for i in range(0, len(text), leaf)]
    joined, ids = ENCODER.concat(leaves, window)
    assert joined == text
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids == ENCODER.encode(text)


# -- quality ---------------------------------------------------------------
def brute_quality(x):
    w, seen, dup = WORDS.findall(x), set(), 0
    for line in x.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
    cov = {p for k in range(len(w) - 7) if c[tuple(w[k: k + 8])] > 1 for p in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(cov) > 30 * len(w)
    chars = sum(map(len, w))
    bad = False
    for n, limit in quality.TOP_LIMITS.items():
        c = collections.Counter(tuple(w[k: k + n]) for k in range(len(w) - n + 1))
        if c and (most := max(c.values())) > 1:
            bad |= max(sum(map(len, g)) * most for g, v in c.items() if v == most) / chars > limit
    for n, limit in quality.DUP_LIMITS.items():
        before, later = set(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k: k + n])
            if g in before:
                later.update(range(k, k + n))
            before.add(g)
        bad |= bool(chars) and sum(len(w[p]) for p in later) / chars > limit
    lines = [x_ for x_ in x.split("\n") if WORDS.search(x_)]
    first, dup_chars = set(), 0
    for x_ in lines:
        dup_chars += len(x_) * (x_ in first)
        first.add(x_)
    bad |= bool(lines) and dup_chars / sum(map(len, lines)) > quality.LINE_CHAR_LIMIT
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", x)), dup, len(cov), failed, not (failed or bad)


def test_quality_equals_brute_force(docs, empty):
    want = [(i, *brute_quality(x)) for i, x in inputs(docs)]
    assert rows(quality.repetition_quality(docs), "doc_id", *quality.COUNTS, "base_failed", "kept") == ordered(want)
    assert quality.repetition_quality(empty).count() == 0


def test_quality_compares_words_when_hashes_collide():
    ids = np.array([1, 2, 3, 4, 1, 2])
    first, cls, size = quality._equal_windows(np.zeros(5, np.uint64), ids, 2)
    assert sorted(size.tolist()) == [1, 1, 1, 2] and cls[0] == cls[4]


# -- WARC ------------------------------------------------------------------
def test_warc_round_trip_rejects_magic_in_payloads(spark, tmp_path):
    inner = warc.record(99, "http://x", b"inner", warc.base32(hashlib.sha1(b"inner").hexdigest()), None, False).decode()
    html = [None, "", "same", "same", "same", inner * 3, "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "ü" * 5000, "tail" + inner, "WARC/1.1\r\n"]
    data = [(i, f"http://h/{i}", h, "x") for i, h in enumerate(html)] + [(4, None, "same", "x"), (None, "http://n", "null id", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload string")
    manifest = warc.write_archives(pages, str(tmp_path / "w"), file_bytes=20_000)
    got = warc.read_archives(spark, manifest, block_bytes=700)
    lead = {}
    for i, _, h, _ in data:
        lead[h or ""] = max(lead.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in data:
        raw = (h or "").encode()
        kind = "response" if i is None or i == lead[h or ""] else "revisit"
        want.append((i, len(raw), warc.base32(hashlib.sha1(raw).hexdigest()), kind, lead[h or ""] if kind == "revisit" else None))
    assert rows(warc.digests(got), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == ordered(want)
    assert rows(got.filter("record_type = 'response'"), "payload") == ordered([(bytearray((h or "").encode()),) for (_, _, h, _), w in zip(data, want) if w[3] == "response"])
    assert warc.round_trip(pages.filter("false")).count() == 0


# -- language --------------------------------------------------------------
def test_language_learns_and_marks_letterless(spark, docs, empty):
    en, de = "the cat and the dog are in the house with others ", "der hund und die katze sind mit anderen im haus "
    texts = [f"{en}{'on ' * (i % 5)}" if i % 2 else f"{de}{'auf ' * (i % 5)}" for i in range(40)] + [None, "", "123 !!", None]
    langs = ["en" if i % 2 else "de" for i in range(40)] + ["en", None, "de", None]
    d = frame(spark, texts, langs=langs)
    out = {r["doc_id"]: r for r in langid.held_out_predictions(d, size=512).collect()}
    assert all(out[i]["lang_pred"] == langs[i] and 0 < out[i]["score"] <= 1 for i in range(40))
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in range(40, 44))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert langid.held_out_predictions(empty).count() == 0
    assert langid.held_out_predictions(docs).count() == docs.count()
    unlabelled = frame(spark, ["some text"], langs=[None]).withColumn("lang", langid.F.lit(None).cast("string"))
    assert rows(langid.held_out_predictions(unlabelled), "lang_pred", "score") == [("und", 0.0)]


def test_binding_rotates_by_place():
    hd = langid.Space(64, 3)
    a, b, c = (hd.letter(ord(x)).astype(int) for x in "abc")
    key = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    assert (hd.bind(key) == np.roll(a, 2) * np.roll(b, 1) * c).all()


# -- binary records --------------------------------------------------------
def test_records_equal_library_in_order(docs, empty, tmp_path):
    t = Tokenizer.from_file(WORD)
    want, at = [], 0
    for i, x in sorted(inputs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    manifest = binary.write_records(docs, WORD, str(tmp_path / "r"), files=3)
    got = binary.digests(binary.read_records(docs.sparkSession, manifest))
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == ordered(want)
    r = manifest[-1]
    doc, ids = binary.read_record(r["data"], r["index"], r["records"] - 1)
    assert (doc, len(ids)) == (want[-1][0], want[-1][2])
    assert binary.token_records(empty, WORD).count() == 0


WORD_ENCODER, WORD_LIBRARY = binary.WordEncoder(WORD, most=50), Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES | st.sampled_from(["\x1c", "\x85", "\xa0", "Σ", "İ", "ΣΑΣ", "<|startoftext|>", "<|ENDOFTEXT|>"]), max_size=40))
def test_parts_encode_like_whole_texts(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert WORD_ENCODER.encode(text) == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_damaged_record_is_noticed(tmp_path):
    import io

    good = binary.frame(binary.pack(7, np.array([1, 70000], np.uint32)))
    assert binary.unpack(binary.unframe(io.BytesIO(good).read))[1].tolist() == [1, 70000]
    for k in range(len(good)):
        bad = bytes([*good[:k], good[k] ^ 1, *good[k + 1:]])
        with pytest.raises(Exception):
            binary.unframe(io.BytesIO(bad).read)


# -- Katz ------------------------------------------------------------------
def brute_katz(data, cutoff=5):
    toks = [(i, WORDS.findall(x.translate(LOW)) + [None], not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)) for i, x in data]
    c = collections.Counter(w for _, t, learn in toks if learn for w in t)
    n, v = sum(c.values()), len(c)
    d1 = katz.discounts(collections.Counter(c.values()), cutoff)
    kept1 = sum(d1.get(k, 1) * k for k in c.values())
    den1 = n if kept1 < n * (1 - 1e-9) else n + 1
    p1 = {w: d1.get(k, 1) * k / den1 for w, k in c.items()} | {"UNK": 1 - kept1 / den1}
    name = lambda w: w if w in c else "UNK"
    big = collections.Counter()
    for _, t, learn in toks:
        if learn:
            big.update(zip(["BOS", *t[:-1]], t))
    d = katz.discounts(collections.Counter(big.values()), cutoff)
    hist = collections.defaultdict(dict)
    for (h, w), k in big.items():
        hist[h][w] = k

    def prob(h, w):
        seen = hist.get(h, {})
        if not seen:
            return p1[w]
        total, kept, cov = sum(seen.values()), sum(d.get(k, 1) * k for k in seen.values()), sum(p1[x] for x in seen)
        den = total if kept < total * (1 - 1e-9) else total + 1
        return d.get(seen[w], 1) * seen[w] / den if w in seen else (1 - kept / den) / (1 - cov) * p1[w]

    out = []
    for i, t, learn in toks:
        s = sum(math.log10(prob(h, w)) for h, w in zip(["BOS", *map(name, t[:-1])], map(name, t))) if n else 0.0
        out.append((i, not learn, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), s))
    return out, hist, prob, p1


@pytest.mark.parametrize("chunk,part,hot", [(500, 300, 4), (100_000, 1_000_000, 4096), (3_000, 2_000, 60)])
def test_katz_equals_brute_force(docs, empty, chunk, part, hot):
    """Every training word keeps its own bigrams, whatever the chunks, the parts and the histories dealt out by bigram."""
    data = inputs(docs)
    want, hist, prob, p1 = brute_katz(data)
    got = rows(katz.held_out_scores(docs, chunk_tokens=chunk, part_tokens=part, hot=hot), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert [r[:5] for r in got] == [r[:5] for r in ordered(want)]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in ordered(want)], atol=1e-6)
    for h in list(hist)[:300]:  # exactly normalised over all words and the unknown
        assert abs(sum(prob(h, w) for w in p1) - 1) < 1e-9
    assert katz.held_out_scores(empty).count() == 0


def test_katz_hot_words_and_one_long_text(spark):
    """One history with most of the bigrams, one text of many chunks' length, words with one CRC-32, a part without training words."""
    docs = frame(spark, ["the The the"] * 200 + ["the " * 5000 + " ".join(f"the w{i}" for i in range(3000)), "plumless buckeroo plumless", "only here", ""])
    want = ordered(brute_katz(inputs(docs))[0])
    for hot in (1, 4096):
        got = rows(katz.held_out_scores(docs, chunk_tokens=64, part_tokens=100, hot=hot), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-6)


def test_katz_model_table(spark, docs, tmp_path):
    """The written table alone, by its words, gives the brute force's probabilities, and every history adds up to one."""
    katz.train(common.stored(katz.chunks(docs, katz.learns(), 1000), "test"), hot=20).write(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m")).collect()
    _, hist, prob, want = brute_katz(inputs(docs))
    one = {r["number"]: r for r in m if r["order"] == 1}
    name = {k: "BOS" if k == katz.BOS else "UNK" if k == katz.UNK else bytes(r["word"]).decode() or None for k, r in one.items()}
    p1 = {k: 10 ** r["logp"] for k, r in one.items() if r["logp"] is not None}
    assert {name[k]: pytest.approx(p) for k, p in p1.items()} == want
    two = collections.defaultdict(dict)
    for r in m:
        if r["order"] == 2:
            two[r["history"]][r["number"]] = 10 ** r["logp"]
    assert {name[h]: {name[w] for w in seen} for h, seen in two.items()} == {h: set(seen) for h, seen in hist.items()}
    for h, seen in two.items():
        assert all(p == pytest.approx(prob(name[h], name[w])) for w, p in seen.items())
        assert abs(sum(seen.values()) + 10 ** one[h]["bow"] * sum(p for k, p in p1.items() if k not in seen) - 1) < 1e-9


def test_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert rows(katz.held_out_scores(frame(spark, ["a b"], [held])), "base_score", "score", "train_tokens") == [(0.0, 0.0, 0)]


# -- SimHash ---------------------------------------------------------------
def brute_fingerprint(x):
    w = WORDS.findall(x.translate(LOW))
    sh = [" ".join(w[k: k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, limit):
    root = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= limit:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_simhash_equals_brute_force(docs, empty):
    data = inputs(docs)
    fps = [brute_fingerprint(x) for _, x in data]
    root = brute_components(fps, 2)
    low = {r: min((i for (i, _), q in zip(data, root) if q == r and i is not None), default=None) for r in root}
    want = [(i, f"{f:016x}", low[r]) for (i, _), f, r in zip(data, fps, root)]
    for group in (32768, 2):
        got = simhash.digests(simhash.near_duplicates(docs, group_rows=group))
        assert rows(got, "doc_id", "fingerprint", "component_id") == ordered(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.deduplicate(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 255), min_size=1, max_size=60, unique=True), st.integers(0, 3), st.integers(2, 5))
def test_gray_index_finds_all(values, limit, fan):
    x = np.array(values, np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    q, leaf = simhash.GrayIndex(x, fan=fan).search(x, limit)
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if int(x[i] ^ x[j]).bit_count() <= limit}
    assert set(zip(q.tolist(), leaf.tolist())) == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


# -- decontamination -------------------------------------------------------
def test_decontamination_equals_brute_force(spark, docs, empty):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, PASSAGE), (2, "one TWO, three"), (10, "fox jumps over the lazy dog and runs away from all the others"), (3, None), (4, "..."), (2, "One two three"), (None, "shared id"), (5, "nd nd")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window long")
    win = collections.defaultdict(set)
    for i, t in items:
        if w := rx.findall((t or "").translate(LOW)):
            for k in range(max(1, len(w) - 9)):
                win[tuple(w[k: k + 10])].add(i)
    want = []
    for i, x in inputs(docs):
        w, hit, found = rx.findall(x.translate(LOW)), set(), set()
        for n in {len(g) for g in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in win:
                    hit.update(range(k, k + n))
                    found |= win[tuple(w[k: k + n])]
        found.discard(None)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    for block in (200_000, 12):  # one pass, and several
        got = decontam.digests(decontam.scan_benchmark(docs, bench, block_windows=block))
        assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == ordered(want)
    bad = {w[0] for w in want if w[5]}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == ordered([(i,) for i, _ in inputs(docs) if i not in bad])
    assert decontam.scan_benchmark(docs, bench.filter("false")).filter("size(hits) > 0").count() == 0
    assert decontam.scan_benchmark(empty, bench).count() == 0


# -- suffix array ----------------------------------------------------------
def brute_suffix(data, length):
    raws = [x.encode() for _, x in data]
    c = collections.Counter(r[k: k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(data, raws):
        m = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if c[r[k: k + length]] > 1:
                m[k: k + length] = True
        m = m[: len(r)]
        edge = int((np.diff(np.concatenate([[0], m.view(np.int8), [0]])) == 1).sum())
        out.append((i, len(r), int(m.sum()), edge, hashlib.sha256(np.frombuffer(r, np.uint8)[~m].tobytes()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_equals_brute_force(docs, empty, hot):
    cut = suffix.remove_spans(suffix.duplicate_spans(docs, hot_members=hot, bucket_bytes=2000))
    assert rows(suffix.digests(cut), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(inputs(docs), 200)
    assert suffix.duplicate_spans(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=90) | st.text("ab", min_size=40, max_size=120).map(str.encode), min_size=1, max_size=8))
def test_column_wise_construction(members):
    members = list(dict.fromkeys(members))
    c = collections.Counter(m[k: k + 40] for m in members for k in range(len(m) - 39))
    got = suffix.repeated_windows(members, np.ones(len(members)), 40)
    assert [g.tolist() for g in got] == [[c[m[k: k + 40]] > 1 for k in range(max(0, len(m) - 39))] for m in members]


def test_clean_keeps_columns(docs):
    out = suffix.clean(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] not in (3, 5, None)}
    assert 10 not in texts and texts[15] == TEXTS[15] and texts[0] == ""


# -- sentence spans --------------------------------------------------------
def test_spans_equal_brute_force(docs, empty):
    data = ordered({(i, x) for i, x in inputs(docs)})
    first, seen = {}, collections.Counter()
    # among rows that share an id the smaller text hash comes first
    keys = {(r["doc_id"], r["text"]): r["h"] for r in docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    for i, x in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, keys[r])):
        for at, _, h in spans.runs(spans.sentences(x), 3, 12):
            first.setdefault(h, (i, x, at))
            seen[h] += 1
    want = []
    for i, x in inputs(docs):
        parts, gone = spans.sentences(x), set()
        for at, k, h in spans.runs(parts, 3, 12):
            if first[h] != (i, x, at):
                gone.update(range(at, at + k))
        kept, p = "", 0
        for s in sorted(gone):
            kept, p = kept + x[p: parts[s][0]], parts[s][1]
        want.append((i, len(parts), len(gone), kept + x[p:]))
    got = spans.span_duplicates(docs)
    assert ordered((r["doc_id"], r["n_sentences"], len(r["removed"]), r["kept"]) for r in got.collect()) == ordered(want)
    assert spans.span_duplicates(empty).count() == 0


def test_repeated_passage_goes_and_first_stays(spark):
    d = frame(spark, ["Clean words of one text only. Nothing here comes twice at all. Yes.", "Intro of its own. " + PASSAGE, "Other begin. " + PASSAGE + "Own end."])
    got = {r["doc_id"]: r for r in spans.span_duplicates(d).collect()}
    assert len(got[0]["removed"]) == len(got[1]["removed"]) == 0
    assert "word20" not in got[2]["kept"] and "Own end." in got[2]["kept"] and "Other begin." in got[2]["kept"]


def test_names_tell_strings_of_one_hash_apart(monkeypatch):
    data = np.frombuffer(b"abcabcabdabc" * 40 + b"xyz", np.uint8)
    raw = data.tobytes() + bytes(64)
    groups = lambda n: {tuple(np.flatnonzero(n == v)) for v in np.unique(n)}
    good = {}
    for i in range(len(data)):
        good.setdefault(raw[i: i + 40], []).append(i)
    expect = {tuple(v) for v in good.values()}
    assert groups(suffix._names(data, 40)) == expect
    monkeypatch.setattr(suffix, "B", np.uint64(0))  # all hashes are equal now
    assert groups(suffix._names(data, 40)) == expect
