import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from peakforge.llm import chat, classifier, decontam, lines, mixing, neardup, quality, substring, tokens, warc
from peakforge.llm.queries import TOKENIZER

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, size int, key string"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, nulls, empty, short and long texts, repeated rows, a repeated id."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocab) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    out = [(i, prose(rng.choice([3, 20, 80, 300]))) for i in range(60)]
    passage = prose(50)
    out += [(60 + i, f"{prose(30)} {passage}\n{prose(20)}") for i in range(5)]
    base = prose(200).split(" ")
    for i in range(12):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(200)] = "zz" + str(rng.random())
        out.append((100 + i, " ".join(words)))
    out += [(200, out[3][1]), (201, out[3][1].upper()), (202, None), (203, ""), (204, " \n\t"), (205, "a b"), (206, "a b"), (207, "x " * 200), (208, "é ü ö <|endoftext|> </s>  two"), (None, "no id here"), (205, "a b"), (209, prose(20000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, ["en", "de", None, "xx"][i % 4], ["s1", "s0", "s0", None, "s0"][i % 5], 1, "clash") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(WORD, t or "")


def test_near_duplicates(docs, texts, none):
    def shingles(t):
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: shingles(t) for d, t in texts if d is not None}
    root = {d: d for d in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], r.doc_id == root[r.doc_id])
    kept = neardup.first_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({d for d in root if root[d] == d})
    assert neardup.near_duplicates(none).count() == 0


def test_quality_rules(docs, texts, none):
    got = quality.quality_rules(docs).collect()
    by = Counter()
    for t in (t or "" for _, t in texts):
        w = words(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        by[(len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(full) - len(set(full)), len(cover), failed)] += 1
    assert Counter(tuple(r)[2:8] for r in got) == by
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.keep_good(docs).count() == sum(r.kept for r in got)
    assert quality.quality_rules(none).count() == 0


def test_kneser_ney_sums_to_one(docs):
    model = quality.fit(docs)
    for context in (0, 5, 1 << 7, 12345):
        p = np.exp(model.logp(1, np.arange(32) + (context << 5)))
        assert abs(p.sum() - 1) < 1e-6


def test_bands_of_any_language(spark):
    rng = random.Random(4)
    tongues = {"ru": "абвгдежзийклмнопрсту", "pt": "aeiorstnmdlcp", "zh-TW": "的一是不了人我在有他这为之大来", None: "qwxzkjvyfg"}

    def prose(lang, n):
        vocab = random.Random(str(lang))
        known = ["".join(vocab.choice(tongues[lang]) for _ in range(vocab.randint(2, 7))) for _ in range(150)]
        return " ".join(rng.choice(known) for _ in range(n))

    rows = [(lang, prose(lang, 120)) for lang, n in (("pt", 150), ("ru", 40), ("zh-TW", 40), (None, 40)) for _ in range(n)]
    junk = [("ru", " ".join("".join(rng.choice("бпвфмнлрдтжщ") for _ in range(5)) for _ in range(120)))]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows + junk)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    russian = [got[i].log_perplexity for i, (lang, _) in enumerate(rows) if lang == "ru"]
    lost = [rows[i][0] for i in range(len(rows)) if not got[i].kept]
    assert not lost and len({got[i].band for i in range(len(rows))}) == 4
    assert got[len(rows)].log_perplexity > max(russian) + 0.1
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_decontamination(spark, docs, texts):
    bench = spark.createDataFrame([(1, texts[60][1].split("\n")[1]), (2, "Tom has 5 apples and Tom buys 7 more so how many apples does he own now"), (3, None), (4, "too short"), (5, "nobody says this in any of the texts that we look through here")], "item_id long, text string")
    more = spark.createDataFrame([(900, "We ask: if Ann has 9 apples and Ann buys 3 more so how many apples does he own now ok"), (901, "We ask: if Ann has 9 apples and Bob buys 3 more so how many apples does he own now ok")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows, bench).collect()}
    assert (60, 1) in got and (900, 2) in got and not any(d in (901, 61) for d, _ in got) and all(i in (1, 2) for _, i in got)
    assert decontam.without_items(docs, bench).count() == len(texts) - len({d for d, _ in got if d != 900})
    assert decontam.contaminated(rows, bench.limit(0)).count() == 0


def test_decontamination_of_passages(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item, long = prose(59).split(), prose(200).split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (3, "Too short!"), (4, "word")], "item_id long, text string")
    quotes = [item[10:35], long[50:140], item[20:33], item[20:32], ["Is", "this", "too", "short?"], ["too", "very", "short"], ["one", "word", "here"]]
    rows = [(i, f"{prose(40)} {' '.join(q)} {prose(40)}") for i, q in enumerate(quotes)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 1), (4, 3), (6, 4)}


def test_decontamination_of_dense_templates(spark):
    items = ["A train travels 60 km in 2 hours and 90 km in 3 hours. What is its speed?", "Tom buys 3 pens and 2 red caps", "In the shop Tom asks for 7 ripe plums and later gives Sam half of them", "3 4 5 6 7 8 9 10"]
    texts = [
        "Look here. A train travels 50 miles in 4 days and 70 miles in 9 days. What is its speed?",
        "Ann buys 5 pens and 8 red caps",
        "So in the shop Mary Ann asks for 9 ripe plums and later gives Bob Lee half of them now",
        "11 12 13 14 15 16 17 18 19 20",
        "A train travels 50 miles in 4 days and 70 km in 9 hours. What is its speed?",
    ]
    rows = lambda x, name: spark.createDataFrame(list(enumerate(x)), f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(rows(texts, "doc_id"), rows(items, "item_id")).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)} and all(r.templated and r.n_windows <= r.n_item_windows for r in got.values())
    assert got[0, 0].n_windows == 11


def test_decontamination_of_units(spark):
    """Any word right after a number may be a unit; one unit must stand for one other throughout, and words elsewhere are no units."""
    items = ["The car sets off at 80 km and returns at 60 km after lunch today", "Each disk holds 4 TB and she fills 3 disks with scans of old maps", "They drank 2 pints of milk before the long walk over the hill"]
    texts = [
        "the car sets off at 85 kph and returns at 65 kph after lunch today",
        "the car sets off at 85 kph and returns at 65 knots after lunch today",
        "each disk holds 16 zettabytes and she fills 9 platters with scans of old maps",
        "they drank 5 flasks of milk before the long walk over the hill",
        "they drank, in 1900, flasks of wine before the short walk up a hill",
        "She said so. They drank 7 jars of milk before the long walk over the hill",
    ]
    rows = lambda x, name: spark.createDataFrame(list(enumerate(x)), f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows(texts, "doc_id"), rows(items, "item_id")).collect()}
    assert got == {(0, 0), (2, 1), (3, 2), (5, 2)}


def test_mixing(docs, texts, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(texts) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    n = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        n[r.source_size, r.target] += r.taken
    total = sum(r.size for r in got)
    assert abs(sum(t for _, t in n) - 1.5 * total) < 1e-6 * total
    big = max(r.size for r in got)
    assert all(abs(k - t) <= big and t <= 2 * s for (s, t), k in n.items())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_substring_dedup(docs, texts, none):
    seen = Counter(tuple(w[i : i + 35]) for _, t in texts for w in [words(t)] for i in range(len(w) - 34))
    want = Counter()
    for d, t in texts:
        w = words(t)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring.repeated_digests(docs).collect())) == want
    assert all(f["size"] >= 35 for r in substring.repeated_passages(docs).collect() for f in r.factors)
    assert substring.repeated_digests(none).count() == 0


def test_token_files(docs, texts, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tokens.read_digests(tokens.write_tokens(docs, TOKENIZER)).collect(), key=lambda r: r.start)
    start = 0
    for (d, t), r in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0], x[1] or "")), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.read_digests(tokens.write_tokens(none, TOKENIZER)).count() == 0


def test_patched_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 1 << 16, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.9] %= 100
            data, sizes = tokens.pack(ids)
            assert (tokens.unpack(data, np.cumsum(sizes) - sizes)[:n] == ids).all()


def test_line_dedup(docs, texts, none):
    rows = [(-1 if d is None else d, i, x) for d, t in dict.fromkeys(texts) for i, x in enumerate((t or "").split("\n"))]
    sets = {x: frozenset(words(x)) for _, _, x in rows}
    gone = Counter()
    for d, i, x in rows:
        a = sets[x]
        gone[d] += any((e, j) < (d, i) and (x == y or a and 100 * len(a & sets[y]) >= 80 * len(a | sets[y])) for e, j, y in rows)
    assert {(-1 if r.doc_id is None else r.doc_id): r.n_removed for r in lines.line_dedup(docs).collect()} == dict(gone)
    assert lines.line_dedup(none).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u\r\nv%0A", "same"), (3, None, None), (4, "w", ""), (None, "n", "é" * 9000), (5, "r", "twice"), (5, "r", "twice")], "page_id long, url string, html string")
    manifest = warc.write_warc(pages)
    got = {(r.page_id, r.record_type): r for r in warc.record_digests(manifest).collect()}
    assert got[1, "revisit"].refers_to == 2 and got[3, "revisit"].refers_to == 4 and got[None, "response"].payload_bytes == 18000 and got[5, "revisit"].refers_to == 5 and (5, "response") in got
    read = warc.read_warc(manifest)
    assert {r.target_uri for r in read.where("record_type = 'response' and page_id in (2, 4)").collect()} == {"u\r\nv%0A", "w"}
    assert bytes(read.where("page_id is null").first().payload).decode() == "é" * 9000
    assert warc.record_digests(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_of_others(spark, tmp_path):
    """Archives without the skip field: a member for each record, one member, none; records of other types, urls in brackets, padding."""
    def other(kind, url, block, **more):
        head = [b"WARC/1.0", b"WARC-Type:" + kind, b"warc-record-id: <urn:uuid:1>", *([b"WARC-Target-URI: " + url] if url else []), *[f"{k}: {v}".encode() for k, v in more.items()], b"Content-Length: %d" % len(block)]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"<p>" + b"\r\n\r\nx%20y" * 30000
    records = [other(b"warcinfo", b"", b"software: none\r\n"), other(b"response", b"<https://a.org/x%20y>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body), other(b"metadata", b"https://b.org", b"", **{"X-Note": "a: b"}), other(b"response", b"https://c.org", b"HTTP/1.1 200 OK\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records) + b"\0" * 100)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    (tmp_path / "d.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    (tmp_path / "e.txt").write_bytes(b"no archive")
    manifest = warc.archives(spark, f"file://{tmp_path}")
    assert {r["name"] for r in manifest.collect()} == {"a.warc.gz", "b.warc.gz", "c.warc", "d.warc.gz"}
    read = warc.read_warc(manifest)
    got = Counter((r.record_type, r.target_uri, bytes(r.payload)) for r in read.collect())
    want = [("warcinfo", None, b"software: none\r\n"), ("response", "https://a.org/x%20y", body), ("metadata", "https://b.org", b""), ("response", "https://c.org", b"")]
    assert got == {x: 4 for x in want}
    assert [r.record_type for r in read.where("target_uri = 'https://b.org'").collect()] == ["metadata"] * 4
    assert read.where("record_type = 'response' and target_uri like 'https://a%'").count() == 4
    assert {r.payload for r in warc.read_warc(manifest, payload=False).collect()} == {None}

    pages = spark.createDataFrame([(1, "https://a.org/x%20y", "same"), (2, "u\n%", "same"), (3, "<b>", "z")], "page_id long, url string, html string")
    own = warc.write_warc(pages)
    assert {r.page_id: r.target_uri for r in warc.read_warc(own).collect()} == {1: "https://a.org/x%20y", 2: "u\n%", 3: "<b>"}
    text = "".join(gzip.decompress(open(f"{r.folder.removeprefix('file:')}/{r['name']}", "rb").read()).decode() for r in own.collect())
    refers = re.findall("WARC-Refers-To: (.*)\r", text)
    assert "WARC-Target-URI: https://a.org/x%20y\r" in text and len(refers) == 1 and text.count(f"WARC-Record-ID: {refers[0]}\r") == 1


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b<|turn|>\\<|", "<<SYS>>\\\\<s>", ""]
    assert all(chat.unescape(chat.escape(x)) == x and not any(c in chat.escape(x) for c in chat.CONTROL) for x in hard)
    rows = [(1, i, r, [{"type": "text", "text": x}, {"type": "image", "ref": "i.png", "width": 56, "height": 30}]) for i, (x, r) in enumerate(zip(hard, ["user", "assistant", None, "assistant"], strict=True))] + [(None, None, "assistant", None)]
    full = [(a, b, c, d and [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in d]) for a, b, c, d in rows]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(full, f"conv_id long, turn long, role string, parts {chat.PARTS}")).collect()}
    assert [t for _, t in chat.parse(out[1].formatted)] == [f"{x}<|image:{i}|>" for i, x in enumerate(hard)]
    assert [(a.ref, a.tokens) for a in out[1].attachments] == [("i.png", 4)] * 4 and len(out[1].loss) == 2
    assert out[None].formatted == chat.START + "assistant" + chat.SEP + chat.END


def test_classifier(spark, none):
    rows = [(i, "plain words of prose that go on " * 5 if i % 2 else "#### $$$$ |||| " * 9) for i in range(600)] + [(9999, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 600").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = classifier.classify(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 602 and len(held) > 100 and all(r.predicted == r.doc_id % 2 for r in held if r.doc_id < 600)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5} and classifier.classify(none, labels).count() == 0
