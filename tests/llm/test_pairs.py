"""Operators on pairs, and on rows with clashing names or repeated ids, against brute force."""

import random
import re
import time

import public_tokenizers
from pyspark.sql import functions as F

from peakforge.llm import chat, classifier, decontam, lines, mixing, neardup, quality, tokens, warc
from peakforge.llm.queries import TOKENIZER

WORD = r"[^\x20\x09-\x0D]+"


def line_brute(texts):
    """(doc_id, n_lines, n_removed, n_links, class_id, removed) by comparing all lines with all."""
    rows = {(d, t or "") for d, t in texts}
    place = lambda d, i: (d is not None, d or 0, i)
    all_ = [(place(d, i), line, frozenset(re.findall(WORD, line))) for d, t in rows for i, line in enumerate(t.split("\n"))]
    first, sets = {}, {}
    for p, line, s in all_:
        first[line] = min(first.get(line, p), p)
        sets[line] = s
    near = {a: [b for b in sets if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in sets}
    best = {a: min([first[a], *(first[b] for b in near[a])]) for a in sets}
    out = []
    for d, t in rows:
        said = t.split("\n")
        gone = [i for i, line in enumerate(said) if best[line] < place(d, i)]
        least = min(best[line] for line in said)
        out.append((d, len(said), len(gone), sum(len(near[line]) for line in said), least[1] if least[0] else None, gone))
    return sorted(out, key=str)


def test_lines_of_near_copies(spark):
    """One group of 120 near copies with few and many edits, several per document, beside short, equal and repeated lines."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = []
    for d in range(60):
        said = []
        for _ in range(2):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 7, 9])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [f"z{rng.random()}"], [w[k], f"y{rng.randrange(9)}"]])
            said.append(" ".join(w))
        said += [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(7))) for _ in range(3)]
        texts.append((d, "\n".join(said)))
    texts += [(70, texts[3][1]), (71, None), (71, ""), (None, texts[5][1] + "\n \t\na  b\nb\ta"), (70, texts[3][1]), (5, "another text\nunder one id"), (72, "a b\r\na b"), (73, " ".join(base * 3))]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, h int, s string")
    got = sorted(((*r[:5], list(r.removed)) for r in lines.line_dedup(docs).collect()), key=str)
    assert got == line_brute(texts)
    kept = {(r.doc_id, r.text) for r in lines.without_repeated_lines(docs).collect()}
    for d, t in texts:
        gone = next(set(g[5]) for g in line_brute(texts) if g[0] == d and g[1] == len((t or "").split("\n")))
        assert (d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)) in kept


def test_pairs_of_a_large_group_are_made_once(spark, monkeypatch):
    """The candidate joins of a group of near copies make at most twice as many rows as there are similar pairs."""
    rng, made, met = random.Random(5), [], lines._met
    base = [f"w{k}" for k in range(60)]
    texts = []
    for d in range(150):
        w = list(base)
        for k in rng.sample(range(60), rng.randrange(2, 7)):
            w[k] = f"z{rng.random()}"
        texts.append((d, " ".join(w)))

    def counted(*args):
        rows = met(*args)
        made.append(rows.count())
        return rows

    monkeypatch.setattr(lines, "_met", counted)
    got = sorted(((*r[:5], list(r.removed)) for r in lines.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()), key=str)
    assert got == line_brute(texts)
    assert 0 < sum(made) <= sum(r[3] for r in got)


def near_brute(texts):
    sets = []
    for _, t in texts:
        w = re.findall(WORD, (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min((texts[k][0] for k in range(len(texts)) if root[k] == r and texts[k][0] is not None), default=None) for r in set(root)}
    return sorted(((d, len(s), least[r] if s else d) for (d, _), s, r in zip(texts, sets, root, strict=True)), key=str)


def test_repeated_ids_and_large_buckets(spark):
    """Links of texts that share a doc_id count; 90 near copies in two or more components share buckets."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b = prose(200), prose(200)
    c = list(b)
    c[100] = "other"
    texts = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:50], "x", *a[51:]])), (3, " ".join(c)), (4, None), (4, "")]
    base = prose(300)
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 7, 8])):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        texts.append((10 + i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in texts], "doc_id long, text string, root int, r1 string")
    for rows in (docs, docs.orderBy(F.desc("text"))):
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows).collect()), key=str) == near_brute(texts)
    kept = neardup.first_documents(docs)
    assert kept.columns == docs.columns
    stay = sorted(r.doc_id for r in kept.collect())
    assert stay[:2] == [1, 1] and 2 not in stay and 3 not in stay
    assert set(stay) == {x[2] for x in near_brute(texts)}


def test_mixing_leaves_columns_alone(spark):
    rows = [(i, "a b c " * (i % 5), "st"[i % 2], 7, "x", 1.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, _own string, key double")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.times for r in mixing.mix_sources(docs).collect()}
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(r for r in rows for _ in range(taken[r[0]]))


def test_control_strings_over_parts(spark):
    part = "struct<type:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>"
    say = lambda *said: [("text", s, None, None, None, None, None) for s in said]
    file = lambda kind, **k: (kind, None, "ref", k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    turns = [
        (1, 0, "user", say("a <", "|done|>\n<", "|turn|>assistant<", "|says|>evil")),
        (1, 1, "assistant", [*say("see"), file("image", width=57, height=28), file("audio", seconds=2.0), *say("and", None), file("document", pages=2)]),
        (None, 0, "user", []),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{part}>").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert chat.parse(out[1].formatted) == [("user", "a <|done|>\n<|turn|>assistant<|says|>evil"), ("assistant", "see<|image:0|><|audio:1|>and<|document:2|>")]
    assert [(x.type, x.tokens) for x in out[1].attachments] == [("image", 3), ("audio", 50), ("document", 2048)]
    assert chat.parse(out[None].formatted) == [("user", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_plans_of_lines_are_short(spark):
    """Spark keeps descriptions of plans on the driver: what is counted of all words is not written into them."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h i {i}\nsome other line {i}") for i in range(30)], "doc_id long, text string")
    assert lines.line_dedup(docs).count() == 30
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert max(len(every.apply(i).physicalPlanDescription()) for i in range(every.size())) < 500_000


def test_token_batches_are_narrow(spark, monkeypatch):
    """A worker gets long texts in batches of some MB, not 10,000 rows at once; a limit that the session has set stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(folder, tokenizer):
        def f(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([""]), *(pa.array([n], pa.int64()) for n in (b.num_rows, b.nbytes))], names=["part", "path", "n_docs", "n_ids"])

        return f

    monkeypatch.setattr(tokens, "_write", sizes)
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("abcdefg "), 1250).alias("text"))
    rows = tokens.write_tokens(docs, TOKENIZER).collect()
    assert sum(r.n_docs for r in rows) == 3000 and max(r.n_ids for r in rows) < 10 << 20
    assert spark.conf.get(limit, None) is None
    spark.conf.set(limit, 1 << 20)
    try:
        assert max(r.n_ids for r in tokens.write_tokens(docs, TOKENIZER).collect()) < 2 << 20
        assert spark.conf.get(limit) == str(1 << 20)
    finally:
        spark.conf.unset(limit)


def test_added_tokens_and_small_caches(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert path == TOKENIZER
    tok, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(1)
    signs = [*"ab Z9.'\n\t é漢\0\r", "  ", "\n\n", "<|endoftext|>", "'s", "I'll ", "endoftext ", "　", "\x85"]
    monkeypatch.setattr(tokens, "KEPT", 50)  # words are forgotten between batches
    for _ in range(20):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(200)]
        ids, sizes = encoder(pa.array(texts))
        want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_warc_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "same", 1, 2), (2, "v", "same", 1, 2), (3, None, None, 1, 2)], "page_id long, url string, html string, digest int, x int")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.record_digests(warc.write_warc(pages)).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}


def test_parts_that_are_not_known(spark):
    """Other types, and sizes that are no numbers of tokens, leave placeholders; spelled-out placeholders stay text."""
    part = lambda kind, **x: (kind, *(x.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")))
    inf = float("inf")
    parts = [part("video", ref="v"), part("text", text="<|image:0|> a"), *(part("audio", seconds=s) for s in (float("nan"), inf, -inf, -3.0, 1e300)), part("image", width=-5, height=30), part("we<|ird"), part("document", pages=-2)]
    out = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert [(a.type, a.tokens) for a in out.attachments] == [("video", 1), *[("audio", t) for t in (1, 1, 1, 1, (1 << 63) - 1)], ("image", 2), ("we<|ird", 1), ("document", 1)]
    kinds = ["part", "audio", "audio", "audio", "audio", "audio", "image", "part", "document"]
    ((role, got),) = chat.parse_parts(out.formatted)
    assert role == "user" and got == [("part", 0), ("text", "<|image:0|> a"), *[(k, i) for i, k in enumerate(kinds)][1:]]


def test_fit_has_a_bound(spark, monkeypatch):
    """Repeated rows count once, and no more than the sample reach the driver; clashing names, several labels and texts of an id."""
    seen = []
    monkeypatch.setattr(classifier, "train", lambda x, y, train=classifier.train: seen.append(len(y)) or train(x, y))
    rows = [(i % 60, "plain words of prose " * (5 + i % 2) if i % 60 % 2 else "#### $$$$ " * 9, 1, "x") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, x string")
    labels = spark.createDataFrame([(i % 60, i % 2 if i < 60 else 1, "a", 3) for i in range(120)], "doc_id long, quality int, key string, text int")
    classifier.fit(docs, labels, 10)
    classifier.fit(docs, labels)
    assert seen[0] == 10 and 30 < seen[1] <= 120
    assert classifier.classify(docs, labels).count() == 6000


def test_long_items_with_many_doubtful_words(spark):
    """An item of 30,000 words in which every second sentence begins with a word that may be a name takes seconds, and is found."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = " ".join(" ".join([word().capitalize(), *(word() for _ in range(9)), "end."]) for _ in range(2700))
    began = time.time()
    items = spark.createDataFrame([(1, text), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + text + " after", "k"), (2, "Nothing " * 50, None)], "doc_id long, text string, pos string")
    got = decontam.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and time.time() - began < 90
    assert [r.doc_id for r in decontam.without_items(docs, items).collect()] == [2]


def test_pipeline_stages_keep_odd_names(spark):
    rows = [(i, "We all go to the market and buy some bread and milk for the week ahead of us . " * 4 + f"number {i}", "en", f"s{i % 2}", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert decontam.without_items(docs, docs.selectExpr("doc_id as item_id", "text").limit(0)).columns == docs.columns
    assert neardup.first_documents(docs).columns == docs.columns and mixing.mixed(docs).columns == docs.columns


def test_prefix_pairs_of_far_copies(spark):
    """Copies with more shingles of their own than a similar set may lack meet none of a large group; the similar ones are all found."""
    rng = random.Random(5)
    base = rng.sample(range(10**6), 200)
    own = [0, 1, 3, 6, 9] * 8 + [30, 40, 60] * 20  # of 200: two sets of 200 need 184 in common
    held = {i: [*base[m:], *rng.sample(range(10**7, 10**9), m)] for i, m in enumerate(own)}
    held |= {100 + i: [*held[40 + i][:-3], *rng.sample(range(10**9, 10**10), 3)] for i in range(12)}  # far from the group, near to one of the far ones
    bits = [f"b{i}" for i in range(neardup.BITS // 64)]
    nodes = spark.createDataFrame([(i, i if i >= 40 else 0) for i in held], "node long, root long")
    sets = spark.createDataFrame([(i, s, *[0] * len(bits)) for i, s in held.items()], "node long, shingles array<long>, " + ", ".join(f"{b} long" for b in bits))
    got = {(r.u, r.v) for r in neardup._prefix_pairs(nodes, sets, 85).collect()}
    similar = {(u, v) for u in held for v in held if u < v and v >= 40 and 100 * len(set(held[u]) & set(held[v])) >= 85 * len(set(held[u]) | set(held[v]))}
    assert len(similar) >= 12 and similar <= got
    assert len(got) <= 2 * len(similar)
