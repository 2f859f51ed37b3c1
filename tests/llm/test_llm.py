"""Corpus operators against brute force and round trips, on texts that include nulls, blanks, copies and long ones."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strand.llm import bpe, chat, langmix, packing, quality, simhash, token_store, toxicity, urls, vptree
from strand.llm.common import saved

R = random.Random(3)
VOCABULARY = ["".join(R.choices("abcdefghij", k=R.randint(2, 7))) for _ in range(300)]
PROSE = [" ".join(R.choices(VOCABULARY, k=R.randint(5, 120))) for _ in range(30)]
ODD = [None, "", " ", "\n\n", "One", "it's a don't 'll x' '", "a\tb\x0bc  d e f", "日本 語 عربى é é naïve ÷×²", "<|endoftext|></w>", "a <|endoftext|> b", "x<|EndOfText|>y é <|startoftext|>", "x " * 3000, "a" * 3000, "12 3a4 a_b 5.6,7\n\n x"]
TEXTS = [*PROSE, *PROSE[:5], PROSE[6] + " extra", *ODD]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], None if k % 7 == 0 else "s", "clash", 1.5) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, ids double").repartition(3)


def empty(docs):
    return docs.limit(0)


def words(t):
    return regex.findall(r"[^\x20\x09-\x0D]+", t or "")


def signals(t):
    w = words(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)} if len(grams) < 2500 else set(range(len(w)))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality(docs):
    out = {r["doc_id"]: r for r in quality.quality_rules(docs).select("doc_id", f"{quality.Q}.*").collect()}
    assert len(out) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        got = out[k]
        want = signals(t)
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == want, repr(t)[:60]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got["base_failed"] == failed and not (failed and got["kept"])
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and quality.quality_filter(empty(docs)).count() == 0
    names = {"f_lang": F.lit("q"), "hi_upper": F.lit(-1), "lo_word_length": F.lit(10**9), "h": F.lit(0), "p": F.lit(0)}
    clash = quality.quality_filter(docs.withColumns(names))
    assert clash.columns == [*docs.columns, *names] and sorted(r["doc_id"] for r in clash.collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_urls(spark):
    given = [None, "x", "http://a.com", "http://A.Com/x?q#f", "http://b.example.com/en/1", "https://www.example.com/en/2", "ftp://www.example.net/es/3", "http://example.org/q/1", "http://example.org#z"] * 3
    given += [f"http://h{k}.example.com/en/{k}" for k in range(60)] + [f"http://h{k}.com/{k}" for k in range(60)]
    pages = spark.createDataFrame([(k % 50, u, "h") for k, u in enumerate(given)], "page_id long, url string, host string")
    out = urls.url_filter(pages).collect()
    assert len(out) == len(given)
    by = {(r["host"], r["path"]): r for r in out}
    assert by["a.com", ""]["rule"] is None and by["a.com", "/x"]["rule"] == "com/" and by["", ""]["score"] == 0
    assert by["b.example.com", "/en/1"]["rule"] == "example.com/en/" and by["www.example.com", "/en/2"]["verdict"] == "allow"
    assert by["www.example.net", "/es/3"]["rule"] == "net/es/" and {r["verdict"] for r in out} == {"allow", "block"}
    assert urls.url_filter(pages.limit(0)).count() == 0
    only = urls.url_filter(pages.where("url like '%example.org%'")).collect()
    assert {(r["verdict"], r["score"]) for r in only} == {("allow", 0.0)}


def slow_url_scores(train, urls_, order):
    """Log-likelihood ratios by the recursion itself, from counts in dictionaries."""
    grams = {}
    for s, verdict in train:
        s = urls.BEGIN + s
        for i in range(1, len(s)):
            for k in range(1, min(i + 1, order) + 1):
                grams.setdefault(s[i - k + 1 : i + 1], [0, 0])[verdict == "block"] += 1
    totals = {}
    for g, n in grams.items():
        own = totals.setdefault(g[:-1], [0, 0])
        own[0], own[1] = own[0] + n[0], own[1] + n[1]

    def chance(context, c, side):
        below = chance(context[1:], c, side) if context else 1 / urls.ALPHABET
        if context not in totals:
            return below
        return (grams.get(context + c, (0, 0))[side] + urls.SMOOTHING * below) / (totals[context][side] + urls.SMOOTHING)

    def score(s):
        s = urls.BEGIN + s
        logs = [np.log(chance(s[max(0, i - order + 1) : i], s[i], 0) / chance(s[max(0, i - order + 1) : i], s[i], 1)) for i in range(1, len(s))]
        return sum(logs) / len(logs)

    return [score(s) if s else 0.0 for s in urls_]


def test_url_scores_threshold_and_verdicts(spark):
    r = random.Random(12)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(1, 7)))
    good = [f"http://{word('abcd')}.com/{word('abcdxé')}/{word('abc')}" for _ in range(60)]
    bad = [f"http://www.{word('efg')}.net/es/{word('efgx')}" for _ in range(60)]
    free = [f"http://{word('abefz')}.org/{word('aegxq日')}" for _ in range(60)] + ["http://zz.org/" + "qa" * 400, "http://", "http://w"]
    given = good + good[:7] + bad + free
    pages = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(given)], "page_id long, url string, host string, g double")
    out = sorted(urls.url_filter(pages).collect(), key=lambda x: x["page_id"])
    ruled = [(x["host"] + x["path"], x["verdict"]) for x in out if x["rule"]]
    open_ = [x for x in out if not x["rule"]]
    assert len(out) == len(given) and len(ruled) == 127 and len(open_) == len(free)
    want = slow_url_scores(ruled, [x["host"] + x["path"] for x in open_], urls.ORDER)
    assert np.allclose([x["score"] for x in open_], want, atol=1e-8)

    parts = spark.createDataFrame([(x["host"], x["path"]) for x in out if x["rule"]], "host string, path string")
    held = [x[0] for x in parts.select(F.pmod(F.xxhash64("host", "path"), F.lit(urls.HELD_OUT)) == 0).collect()]
    apart = [x for x, h in zip(ruled, held) if h]
    scores = slow_url_scores([x for x, h in zip(ruled, held) if not h], [s for s, _ in apart], urls.ORDER)
    buckets = [(int(np.floor(round(v, 9) * urls.STEPS)), verdict) for v, (_, verdict) in zip(scores, apart)]
    n = [sum(v == side for _, v in buckets) for side in ("allow", "block")]
    assert min(n) > 0
    errors = lambda b: sum(x < b for x, v in buckets if v == "allow") / n[0] + sum(x >= b for x, v in buckets if v == "block") / n[1]
    best = min({b for b, _ in buckets}, key=lambda b: (round(errors(b), 12), abs(b), b)) / urls.STEPS
    assert [x["verdict"] for x in open_] == ["allow" if x["score"] >= best else "block" for x in open_]


def word_ids(t):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [e.ids + [1] for e in tk.encode_batch([x or "" for x in t], add_special_tokens=False)]


def test_packing(docs):
    want = word_ids(TEXTS)
    out = packing.digest(docs, packing.word_file()).collect()
    covered, sequences = {}, {}
    for r in out:
        ids = np.array(want[r["doc_id"]], dtype="<u4")
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(len(v))) for k, v in enumerate(want)}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.digest(empty(docs), packing.word_file()).count() == 0


def test_best_fill_is_optimal():
    for seed in range(60):
        r = random.Random(seed)
        lengths = sorted(r.sample(range(1, 30), 5), reverse=True)
        counts, room = [r.randint(0, 3) for _ in lengths], r.randint(1, 60)
        sums = {0}
        for k, n in zip(lengths, counts):
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.best_fill(lengths, counts, room)
        assert sum(k * n for k, n in used) == max(s for s in sums if s <= room)
        assert all(n <= counts[lengths.index(k)] for k, n in used)
    counts = {k: random.Random(k).randint(1, 9) for k in range(1, 64)}
    plan = packing.plan_patterns(counts, 64)
    total = {}
    for times, used in plan:
        assert sum(k * n for k, n in used) <= 64
        for k, n in used:
            total[k] = total.get(k, 0) + n * times
    assert total == counts


def slow_print(t):
    import xxhash

    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, distance=4):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash(docs):
    prints = [slow_print(t) for t in TEXTS]
    p = saved(simhash.fingerprints(docs, ["doc_id"]), "p")
    out = {r["doc_id"]: r for r in simhash.near_duplicate_groups(p, "doc_id").collect()}
    assert {k: r["fp"] % (1 << 64) for k, r in out.items()} == dict(enumerate(prints))
    assert [out[k]["group"] for k in range(len(TEXTS))] == roots(prints)
    kept = simhash.near_duplicate_filter(docs.unionAll(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots(prints)))
    assert simhash.near_duplicate_filter(empty(docs)).count() == 0


@pytest.mark.parametrize("small,large", [(32, 4096), (2, 20)])
def test_pigeonring_finds_every_link(spark, monkeypatch, small, large):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LARGE", large)
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(25)]
    fps = {s for s in seeds}
    for s in seeds:
        for _ in range(12):
            x = s
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    bucket = np.array([i << 32 | (f >> a & ((1 << w) - 1)) for i, (a, w) in enumerate(simhash.segment_masks()) for f in fps])
    values = np.array(fps * simhash.SEGMENTS, dtype=np.uint64)
    order = np.argsort(bucket, kind="stable")
    a, b = simhash.group_links(bucket[order], values[order], simhash.SEGMENTS, simhash.DISTANCE)
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    for x, y in zip(a, b, strict=True):
        i, j = root[at[int(x)]], root[at[int(y)]]
        root = [min(i, j) if v in (i, j) else v for v in root]
    assert root == roots(fps)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 99)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}
    assert simhash.components(edges.limit(0)).count() == 0


def test_byte_bpe(spark, docs):
    own = bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r["doc_id"]: r for r in bpe.digest(docs, own).collect()}
    spans = {r["doc_id"]: r for r in own.encode(docs, offsets=True).collect()}
    for k, t in enumerate(TEXTS):
        ids = encoding.encode_ordinary(t or "")
        assert out[k]["n_tokens"] == len(ids) and spans[k]["token_ids"] == ids
        assert out[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        for i, a, b in zip(ids, spans[k]["starts"], spans[k]["ends"], strict=True):
            assert encoding.decode_single_token_bytes(i) in t[a:b].encode()


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>", "\\<\\[\\\\", None, "", "é\n"]
    rows = [(k % 3 if k < 9 else None, k // 3, "assistant" if k % 2 else "user", texts[k % 6]) for k in range(12)]
    frame = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digest(frame).collect()}
    for conv in (0, 1, 2, None):
        turns = sorted((t, r, x or "") for c, t, r, x in [*rows, rows[0]] if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        got = out[conv]
        assert got["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got["n_turns"] == len(turns)
        assert got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got["loss_chars"] == len(learned)
    formatted = chat.format_turns(chat.canonical_frame(chat.turn_rows(frame))).select("formatted").collect()
    assert all("</s>" not in r[0] and "[INST]" not in r[0] for r in formatted)
    json = ['{"messages":[{"role":"user","content":"hi"}]}', '{"instruction":"a","input":"","output":"b"}', '{"conversations":[{"from":"gpt","value":null}]}', '{"z":1}', "bad", None]
    got = chat.canonical_json(spark.createDataFrame([(j,) for j in json], "j string"), "j").collect()
    assert [r["layout"] for r in got] == ["messages", "instruction_input", "from_value", None, None, None]
    assert got[1]["turns"] == [("user", "a"), ("assistant", "b")] and got[2]["turns"] == [("assistant", "")]
    assert chat.digest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs, tmp_path, encoding):
    import pyarrow.parquet as pq

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [np.array(e.ids + [2], dtype="<u4") for e in tk.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(docs, token_store.byte_file(), path, encoding=encoding)
    out = sorted(token_store.checksums(token_store.read_tokens(spark, path)).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, ids in zip(out, want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = [pq.ParquetFile(f) for f in sorted((tmp_path / "tokens").glob("part-*"))]
    columns = [f.metadata.row_group(0).column(f.metadata.num_columns - 1) for f in files if f.metadata.num_rows]
    assert all(any(("DELTA" if encoding == "delta" else "DICTIONARY") in e for e in c.encodings) and c.has_offset_index for c in columns)
    token_store.write_tokens(empty(docs), token_store.byte_file(), path + "0")
    assert token_store.read_tokens(spark, path + "0").count() == 0


def test_vantage_point_trees(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 8)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(int(k), x.tolist(), "c") for k, x in enumerate(v)]
    rows += [(1000, None, "c"), (1050, [0.0] * 8, "c"), (1100, [float("nan")] * 8, "c"), (1150, [None] * 8, "c"), (None, v[0].tolist(), "c"), (1200, [1.0, 2.0], "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    d = v.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    hits = {}
    for factor in (1.0, 0.5):
        out = vptree.nearest(frame, 50, factor=factor, shard=300).collect()
        hits[factor] = 0
        for q in range(0, 700, 50):
            c = np.round(cos[q], 12)
            c[q] = -2
            want = sorted(range(700), key=lambda k: (-c[k], k))[:5]
            got = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
            hits[factor] += len(set(want) & set(got))
            if factor == 1.0:
                assert got == want
    assert hits[1.0] == 70 and hits[0.5] >= 63
    assert vptree.nearest(frame.limit(0), 50).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    pairs = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in vptree.nearest(twice, 50).collect())
    assert pairs == [(0, 1, 0), (0, 1, 0), (0, 2, 3), (0, 2, 3)]


def test_toxicity(spark):
    r = random.Random(1)
    bad = ["vexgorf", "blarzun"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        w = r.choices(VOCABULARY, k=40) + (r.choices(bad, k=4) if toxic else [])
        r.shuffle(w)
        rows.append((k, " ".join(w), "x", 1))
        labels.append((k, int(toxic)))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "word " * 20000, "x", 1), *rows[:3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, __strand_score int")
    labelled = spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labelled)
    scored = toxicity.score(docs.drop("__strand_score"), model, ["doc_id"])
    assert scored.count() == len(rows)
    out = {x["doc_id"]: x["__strand_score"] for x in scored.collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((out[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert right >= 0.9 * len(held) and out[900] == out[901] < 0.5 and out[902] < 0.5
    kept = toxicity.toxicity_filter(docs, labelled)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(k for k, *_ in rows if out[k] < 0.5)
    assert toxicity.toxicity_filter(docs.limit(0), labelled).count() == 0
    alone = toxicity.fit(docs, labelled.limit(0))
    assert {x["__strand_score"] < 0.5 for x in toxicity.score(docs.drop("__strand_score"), alone, ["doc_id"]).collect()} == {True}


def test_toxicity_savings_are_differences_of_compressed_lengths():
    import zstandard

    r = random.Random(5)
    ordinary = [" ".join(r.choices(VOCABULARY, k=60)) for _ in range(60)]
    toxic = [t + " vexgorf blarzun" for t in ordinary[:30]]
    model = toxicity.fit_texts(toxic, ordinary)
    code = toxicity.code_table()
    coded = lambda s: b"".join(code[c] for c in s)

    def length(text, content):
        parameters = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        own = zstandard.ZstdCompressionDict(coded(content + model.background), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=parameters)
        return len(zstandard.ZstdCompressor(dict_data=own, compression_params=parameters).compress(coded(text)))

    text = "Vexgorf  " + PROSE[0] + "\n" + PROSE[1] + " é日本"
    words = text.lower().split()
    windows = [" " + " ".join(words[i : i + toxicity.WINDOW]) + " " for i in range(0, len(words), toxicity.WINDOW)]
    scorer = model.scorer()
    assert scorer.coder.windows(text) == [coded(w) for w in windows] and toxicity.plain_windows(text) == windows
    assert scorer.savings(scorer.coder.windows(text)).tolist() == [length(w, model.ordinary) - length(w, model.toxic) for w in windows]
    assert "vexgorf" in model.toxic and "vexgorf" not in model.ordinary + model.background
    assert scorer.score(None) == scorer.score("") == scorer.score(" \n")


def test_toxicity_threshold_is_the_best_split():
    r = np.random.default_rng(3)
    for _ in range(30):
        z, y = r.integers(0, 8, 60).astype(float), (r.random(60) < 0.4).astype(float)
        at = toxicity.calibrated_threshold(z, y)
        gain = lambda c: ((z >= c) & (y == 1)).sum() / y.sum() - ((z >= c) & (y == 0)).sum() / (1 - y).sum()
        lost = lambda c: ((z >= c) & (y == 0)).sum() / (1 - y).sum()
        best = max([gain(c) for c in np.unique(z) if lost(c) <= toxicity.CLEAN_LOST], default=0)
        assert lost(at) <= toxicity.CLEAN_LOST and gain(at) == pytest.approx(max(best, 0))


def test_toxicity_of_a_small_language():
    r = random.Random(4)
    small = ["".join(r.choices("qxzjkw", k=5)) for _ in range(60)]

    def texts(words, bad, n):
        drawn = [r.choices(words, k=40) + [r.choice(bad) for _ in bad[:1]] for _ in range(n)]
        return [" ".join(r.sample(w, len(w))) for w in drawn]

    toxic = [*texts(VOCABULARY, ["vexgorf", "blarzun"], 400), *texts(small, ["olmifen"], 24)]
    ordinary = [*texts(VOCABULARY, [], 900), *texts(small, [], 160)]
    r.shuffle(toxic)
    r.shuffle(ordinary)
    s = toxicity.fit_texts(toxic, ordinary).scorer()
    assert sum(s.score(t) >= 0.5 for t in texts(small, ["olmifen"], 20)) >= 18
    assert sum(s.score(t) >= 0.5 for t in texts(small, [], 60)) <= 3


def test_toxicity_of_a_passage_in_a_long_text():
    r = random.Random(6)
    bad = ["vexgorf", "blarzun", "olmifen", "kwozzy"]

    def text(k, n):
        w = r.choices(VOCABULARY, k=k)
        at = r.randrange(k)
        return " ".join([*w[:at], *r.choices(bad, k=n), *w[at:]])

    s = toxicity.fit_texts([text(40, 4) for _ in range(100)], [text(r.choice((40, 900)), 0) for _ in range(300)]).scorer()
    assert sum(s.score(text(4000, 10)) >= 0.5 for _ in range(10)) >= 9
    assert sum(s.score(text(4000, 0)) >= 0.5 for _ in range(10)) <= 1


def test_language_mixtures(spark):
    r = random.Random(2)
    make = lambda letters: " ".join("".join(r.choices(letters, k=5)) for _ in range(60))
    kinds = {"aa": "abcde", "bb": "fghij"}
    rows = [(k, make(kinds[lang]), lang) for k, lang in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame([*rows, (70, None, "aa"), (71, "12 ?", None), (72, make("abcde") + " " + make("fghij"), None)], "doc_id long, text string, lang string")
    model = langmix.fit(docs)
    out = {x["doc_id"]: x for x in langmix.identify(docs, model).collect()}
    assert all(out[k]["lang_pred"] == lang and out[k]["score"] > 0.95 for k, _, lang in rows)
    assert out[70]["lang_pred"] == out[71]["lang_pred"] == "und" and out[70]["score"] == 0
    mixed = {x["lang"]: x["share"] for x in out[72]["languages"]}
    assert mixed["aa"] == pytest.approx(0.5, abs=0.1) and mixed["bb"] == pytest.approx(0.5, abs=0.1)
    none = langmix.fit(docs.limit(0))
    assert {x["lang_pred"] for x in langmix.identify(docs, none).collect()} == {"und"}


def test_language_mixture_of_six(spark):
    r = random.Random(3)
    make = lambda letters, k=60: " ".join("".join(r.choices(letters, k=5)) for _ in range(k))
    kinds = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst", "ff": "uvwx"}
    docs = spark.createDataFrame([(k, make(kinds[lang]), lang) for k, lang in enumerate([*kinds] * 20)], "doc_id long, text string, lang string")
    model = langmix.fit(docs)
    [(_, score, languages)] = langmix.mixtures([" ".join(make(v) for v in kinds.values())], model)
    assert {x for x, _ in languages} == set(kinds) and score == pytest.approx(1 / 6, abs=0.02)


def test_near_duplicate_filter_of_odd_rows(spark):
    text = " ".join(PROSE[0].split() * 3)
    rows = [(None, text), (5, text), (7, text), (None, "alone here"), (9, None), (3, ""), (3, ""), (11, "x " * 5000)]
    docs = spark.createDataFrame([(k, t, 1, "u", 2, 3) for k, t in rows], "doc_id long, text string, fp int, key string, node int, `group` int")
    out = simhash.near_duplicate_filter(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted([("5", text), ("None", "alone here"), ("3", ""), ("11", "x " * 5000)])
    assert simhash.near_duplicate_filter(docs.limit(0)).count() == 0


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    r = random.Random(21)
    rows = [(k, " ".join(r.choices(VOCABULARY, k=60)), "en", "s", 1, 0) for k in range(60)]
    rows += [rows[3], (None, rows[4][1], None, None, 1, 0), (70, None, "en", None, 1, 0), (71, "", None, "s", 1, 0), (72, "word " * 30000, "en", "s", 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int, f_lang int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").where("doc_id IS NOT NULL").count() == 0
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, "").where("length > 0").agg(F.sum("length")).first()[0] > 0 and last(spark, docs.limit(0), "").count() == 0


def test_pipeline_is_its_operators_in_turn(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, frame, sf), name)
        assert after.columns == frame.columns and after.join(frame, frame.columns, "left_anti").count() == 0
        counts.append(after.count())
        frame = after
    left = sorted(r["doc_id"] for r in frame.collect())
    prints = [slow_print(docs[k]) for k in left]
    assert len(set(roots(prints))) == len(left)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    want = dict(zip(left, word_ids([docs[k] for k in left])))
    assert all(r["doc_tokens"] == len(want[r["doc_id"]]) for r in packed)
