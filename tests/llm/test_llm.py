"""The operators against brute force on small fixtures, with nulls, ties, empty tables and clashing extra columns."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import (
    ann_links, chat, html_text, jaccard_join, kernels as K, mixing, packing, quality, suffix_dedup, token_counts, toxicity)
from flowlens.llm import queries as Q
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words long, size long, kept boolean"


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


def cases():
    base, passage = prose(1, 120, 5000), prose(2, 60, 5000)
    near = base.split()
    near[50] = "changed"
    texts = [base, base, " ".join(near), base.upper(), passage + " " + prose(3, 40), prose(4, 30) + "\n" + passage, None, "", "  \n",
             "one two", "ONE two", "é" * 80, "x" + "é" * 80, "a b c d e f g h i j " * 12, "line of text here\n" * 4, passage]
    return [(i, t, [None, "b", "a"][i % 3], 7, 8, False) for i, t in enumerate(texts)] + [(None, base, "a", 1, 1, True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sliding_minimum_and_spans():
    x = np.random.default_rng(0).integers(0, 1000, 57).astype(np.uint64)
    assert K.sliding_min(x, 7).tolist() == [x[i:i + 7].min() for i in range(51)]
    a, b = K.merge_spans(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 12]))
    assert (a.tolist(), b.tolist()) == ([0, 9], [7, 12])


def test_repeats_against_brute_force(docs, empty):
    rows = [(r[0], (r[1] or "").encode()) for r in cases()]
    first = {}
    for d, b in sorted(r for r in rows if r[0] is not None):
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], d)
    found = suffix_dedup.remove_repeats(docs)
    assert {"source", "n_words", "size"} <= set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows)
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49) if d is not None else ():
            if first[b[p:p + 50]] < d:
                gone[p:p + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[d].n_bytes, got[d].n_removed) == (len(b), int(gone.sum())), d
        assert got[d].kept_sha256 == hashlib.sha256(left).hexdigest()
        assert got[d].text == left.decode("utf-8", "ignore")
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_levels_merge_geometrically():
    family = suffix_dedup.Levels()
    for i in range(16):
        seed = np.arange(i * 100, i * 100 + 100, dtype=np.uint64) << np.uint64(33)
        family.add(seed, np.zeros(100, np.uint32), np.full(100, i))
    assert len(family.levels) <= 5 and len(family.all()[0]) == 1600


def near_copies(seed, groups, copies):
    """Groups of near copies of very different closeness, more than a short list holds."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = prose(100 + g, 150, 100_000).split()
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 7)):
                words[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_jaccard_against_brute_force(spark, docs, empty):
    want = brute_components([r[:2] for r in cases() if r[0] is not None])
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.join_components(docs).collect()}
    assert got.pop(None)[1] is None and got == want
    rows = near_copies(5, 3, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in jaccard_join.join_components(frame).collect()} == brute_components(rows)
    assert jaccard_join.join_components(empty).count() == 0


def test_long_lists_travel_bounded(spark):
    """Documents with very many long lists: every entry is a bounded row, and a pair is met if it shares any list."""
    rng, rows = np.random.default_rng(8), []
    for doc in range(6):
        keys = np.sort(rng.choice(600, 400, replace=False))
        rows += [(1, int(k), doc, 0, 2000, i) for i, k in enumerate(keys)]
    rows += [(1, 900 + k, 6 + d, 0, 2000, 3 * k + (k > 0)) for k in range(30) for d in range(2)]
    rows += [(1, -k - 1 - 100 * d, 6 + d, 0, 2000, k) for k in range(1, 80) for d in range(2)]
    merged = spark.createDataFrame(rows, jaccard_join.PAIRS)
    near = spark.createDataFrame([], "a long, component long")
    sketches = spark.createDataFrame([(d, bytes(64)) for d in range(8)], "_id long, sketch binary")
    made = jaccard_join.long_entries(merged, near, sketches).toArrow()
    assert len(made) == len(rows) and max(len(x) for x in made["lists"].to_pylist()) <= 16
    found = jaccard_join._across(made, 80)
    assert set(zip(*(found[c].to_pylist() for c in "ab"), strict=True)) == {*itertools.combinations(range(6), 2), (6, 7)}


def test_jaccard_of_long_near_copies(spark):
    rows = []
    for seed in range(2):
        base = prose(40 + seed, 1500, 100_000).split()
        for copy in range(5):
            words = list(base)
            for at in np.random.default_rng([seed, copy]).integers(0, 1500, 25 * copy):
                words[at] = f"e{seed}x{copy}x{at}"
            rows.append((len(rows), " ".join(words)))
    got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_components(rows)


def covered(words, n):
    at = defaultdict(list)
    for i in range(len(words) - n + 1):
        at[tuple(words[i:i + n])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(n)})


def test_quality_against_brute_force(docs, empty):
    texts = [t for _, t, *_ in cases()] + [prose(s, 300, 5) for s in range(5)]
    for lo, _, data, offsets in K.chunks(pa.array(texts)):
        got = quality.judge(data, offsets, quality.RULES)
        for i in range(len(offsets) - 1):
            words = WORD.findall(texts[lo + i] or "")
            longest = next((n for n in range(len(words), 4, -1) if covered(words, n)), 0)
            assert (got["n_words"][i], got["n_repeat_words"][i]) == (len(words), covered(words, 5))
            assert (got["covered_words"][i], got["longest_repeat"][i]) == (covered(words, 10), longest)
            assert got["word_chars"][i] == sum(map(len, words))
    found = quality.score(docs)
    assert found.count() == len(cases()) and {"source", "size"} <= set(found.columns) and quality.score(empty).count() == 0


def test_quality_of_batches_without_text(spark):
    """A partition of null and empty texts, and empty texts behind one that fills a chunk."""
    long_ = prose(9, 500_000)
    rows = [(1, None), (2, ""), (3, long_), (4, ""), (5, None)]
    found = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert len(long_) > K.CHUNK_BYTES and found[3].n_words == 500_000
    assert all(found[d].n_words == 0 and found[d].base_failed and not found[d].kept for d in (1, 2, 4, 5))
    bare = quality.score(spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1))
    assert [r.n_dup_lines for r in bare.collect()] == [0, 0]


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file()
    tokenizer = Tokenizer.from_file(path)
    hard = ["Don't STOP it's", "İstanbul Σίσυφος ΟΔΟΣ", "a<|endoftext|>b <|ENDOFTEXT|>", "É×÷ÀÈß", "12ab34 3.14 \x1c\x00a", "日本語 a̸=", "?!.a,b"]
    for _, _, data, offsets in K.chunks(pa.array(hard)):
        got = [x.tolist() for x in packing.word_ids(path).encode(data, offsets)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in hard]
    many = spark.createDataFrame([(i, prose(i, 1 + 37 * i % 900)) for i in range(300)], "doc_id long, text string").repartition(20)
    rows = packing.pack_documents(many, path, length=256, open_windows=4, merge_parts=4).collect()
    ids = {r[0]: np.array(tokenizer.encode(r[1], add_special_tokens=False).ids + [1], "<u4") for r in many.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert set(pieces) == set(ids)
    for d, found in pieces.items():
        spans = sorted((r.start, r.length) for r in found)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) == len(ids[d])
    for found in sequences.values():
        spans = sorted((r.offset, r.length) for r in found)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 256
    assert len(sequences) * 256 <= 1.05 * sum(map(len, ids.values())) + 256
    assert sum(r.length for r in packing.pack_documents(docs, path).collect() if r.doc_id is None) > 0
    assert packing.pack_documents(empty, path).count() == 0


def test_mixing_targets_and_limits(docs, empty, spark):
    rows = [(i, prose(i, 5 + i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    target, left, open_ = {}, sum(size.values()), set(size)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in mixing.mix(frame).collect():
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 55 for s in target)
    assert mixing.mixed_rows(frame).count() == sum(r.copies for r in mixing.mix(frame).collect())
    assert mixing.mix(docs).count() == len(cases()) and mixing.mix(empty).count() == 0


def test_field_against_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 3, 7):
        score, step, bounds = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), np.array([0, min(2, n), min(2, n), n])
        starts, total, wanted = set(bounds[:-1].tolist()), 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            w = np.exp(score @ np.array(states) + sum(step[states[i - 1], states[i]] for i in range(1, n) if i not in starts))
            total, wanted = total + w, wanted + w * np.array(states)
        assert np.allclose(toxicity.marginals(score, bounds, step)[0], wanted / total)


def test_toxicity_finds_marked_texts(spark, empty):
    rng = np.random.default_rng(3)
    texts = [prose(s, 60) + (f" nasty{rng.integers(0, 9)} horrid " if s % 4 == 0 else " ") + prose(s + 9999, 40) for s in range(600)]
    model = toxicity.fit_texts(pa.array(texts[:400]), np.arange(400) % 4 == 0)
    score, count, _ = toxicity.score_texts(model, pa.array([*texts[400:], "", None]), 0.5)
    assert ((score[:200] >= 0.5) == (np.arange(200) % 4 == 0)).mean() > 0.97 and score[200] == score[201] < 0.5
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i % 7 else None) for i in range(400)], "doc_id long, toxic int")
    fitted = toxicity.fit(frame, labels)
    hits = toxicity.score(frame, fitted).where("doc_id >= 400 and (score >= 0.5) = (doc_id % 4 = 0)").count()
    assert hits > 190
    assert toxicity.fit(frame, labels.where("toxic = 0")) == 0.0 and toxicity.score(empty, 0.0).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * 0.04 * (i % 5)).tolist(), i % 3 if i % 11 else None) for i in range(500)]
    rows += [(500 + i, rows[6][1], rows[6][2]) for i in range(80)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [], 1), (604, [None] + [1.0] * 15, 1), (605, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [r for r in rows if r[2] is not None and r[0] < 600]
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in ok}
    links, root = defaultdict(int), {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.98:
            links[a[0]] += 1
            links[b[0]] += 1
            x, y = sorted((top(a[0]), top(b[0])))
            root[y] = x
    got = ann_links.link_vectors(frame, capacity=64, query_group=50, width=8).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        r[0]: (links[r[0]], top(r[0]), top(r[0]) == r[0]) for r in rows}
    assert ann_links.link_vectors(frame.where("false")).count() == 0


def test_html_cases(spark):
    page = ("<html><head><title>No</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div>"
            "<article><h1>Head &amp; line</h1><p><b>First  bold<br><p>Second &lt;b&gt;\n text</p><ul><li>one<li>two</ul>"
            "<form>name</form><div class='comments'>bad comment</div></article><aside>side</aside><footer>&copy; foot</footer></body></html>")
    assert html_text.main_text(page) == "Head & line\nFirst bold\nSecond <b> text\none\ntwo"
    plain = "<div id=sidebar><p>" + "x " * 400 + "</p></div><div><p>" + "long text " * 30 + "</p><p>more of it " * 9 + "</p></div><div>tiny</div>"
    assert html_text.main_text(plain).startswith("long text") and "tiny" not in html_text.main_text(plain)
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "just text", "<div><div></p>")] == ["", "", "<", "<p", "just text", ""]
    frame = spark.createDataFrame([(1, page, "u"), (2, None, "v")], "page_id long, html string, text string")
    assert {r.page_id: r.n_chars for r in html_text.extract(frame).collect()}[2] == 0


def test_html_names_are_hints():
    """A name or a form around the article takes nothing of it; boxes with such names still go."""
    article, box = "<h1>Head</h1>" + "<p>" + "long text " * 30 + "</p>", "<div class='site-footer'>foot</div>"
    want = "Head\n" + ("long text " * 30).strip()
    for open_, end in (("<div class='content with-sidebar'>", "</div>"), ("<div id=page class=no-sidebar>", "</div>"),
                       ("<div class='social-article'>", "</div>"), ("<form id=aspnetForm><input value=x>", "</form>")):
        assert html_text.main_text(f"<body>{open_}{article}{end}{box}</body>") == want, open_
        bare = article.replace("<h1>Head</h1>", "")
        assert html_text.main_text(f"<body>{open_}{bare}{end}{box}</body>") == want[5:], open_
    assert html_text.main_text(f"<div><div class='post-header'><h1>Head</h1></div>{article[13:]}</div>{box}") == want
    parts = "".join(f"<div class='widget-part'><p>{'long text ' * 30}</p></div>" for _ in "ab")
    assert html_text.main_text(f"<div class='widget-page'>{parts}</div>") == "\n".join([want[5:]] * 2)
    assert html_text.main_text(f"<div class=ad>{'buy this ' * 90}</div><article>{article}</article>") == want
    posts = "".join(f"<li class=comment><article class='comment-body'>{'said so ' * 60}</article></li>" for _ in "abc")
    assert html_text.main_text(f"<div><p>{'long text ' * 30}</p></div><ol class='commentlist'>{posts}</ol>") == want[5:]


def test_token_counts_against_longest_match(docs, empty):
    path = Q.tokenizer_file("byte_bpe_50k.tiktoken")
    words = token_counts.read_vocabulary(path)
    known, matcher = set(words), token_counts.Matcher(words)

    def naive(word):
        at = n = 0
        while at < len(word):
            end = next(e for e in range(len(word), at, -1) if word[at:e] in known)
            at, n = end, n + 1
        return n

    samples = [b" " + w for t in (prose(1, 50), "Straße 日本語 internationalization aaaaaaaaaaaaa \x00\x01") for w in t.encode().split()]
    assert [matcher.count(w) for w in samples] == [naive(w) for w in samples]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {d: sum(naive(b" " + w) for w in (t or "").encode().split()) for d, t, *_ in cases()}
    assert token_counts.count_tokens(empty, path).count() == 0


def test_chat_collapses_snapshots(spark):
    def log(conv, *texts):
        return [(conv, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)]

    rows = [*log(1, "a", "b"), *log(2, "a", "b", "c"), *log(3, "a", "b", "c"), *log(4, "a", "x"), *log(5, None), *log(6, ""),
            *log(None, "z"), *log(7, *[str(i) for i in range(3000)]), *log(8, *[str(i) for i in range(2000)])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_equal) for r in chat.render(frame).collect()}
    assert got == {2: (3, 2), 4: (2, 1), 5: (1, 2), None: (1, 1), 7: (3000, 1)}
    text = {r.conv_id: r.text for r in chat.render(frame).collect()}[4]
    assert text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.render(frame.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_registered_queries(spark, name):
    df = Q.QUERIES[name](spark, SF_DIR)
    if name in Q.ORACLES:
        assert compare(df, connect(SF_DIR), Q.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_pipeline_stages(spark):
    """Each stage against the brute-force decision on its own input."""
    import corpus_pipeline as P

    docs = spark.createDataFrame(
        [(r[0], r[1], "en", r[2], 1) for r in cases() if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long")
    by_name = dict(P.STAGES)
    kept = by_name["quality"](spark, docs, SF_DIR)
    texts = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} == {
        d for d, w in texts.items() if len(w) >= 10 and covered(w, 5) * 100 <= 20 * len(w) and covered(w, 10) * 100 <= 15 * len(w)
        and not covered(w, 101)}
    one = by_name["near_copies"](spark, docs, SF_DIR)
    assert {r.doc_id for r in one.collect()} == {c for _, c in brute_components([r[:2] for r in docs.collect()]).values()}
    for name in ("quality", "near_copies", "repeats", "mix"):
        assert by_name[name](spark, docs, SF_DIR).columns == docs.columns
    packed = P.run(spark, SF_DIR)
    assert packed.columns == [n for n, _ in packing.FIELDS] and packed.count() > 0
