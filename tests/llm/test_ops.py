"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ann, exact_dedup, html_extract, mixing, near_dup, packing, quality, token_counts, token_output, tokens, warc
from scriptorium.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and odd texts, ties, repeated rows, a long text.
ODD = [
    (1, "a  b\tc", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n", "en", None, 2), (None, "a b c", "en", "s", 5), (7, "A b c", "en", "s", 5),
    (2, "a b c", "en", "s", 5), (8, "word " * 30000, "en", "s", 1), (9, "x" * 70000, None, "t", 1), (10, "日本語 テキスト 🙂", "ja", "é", 9), (11, "one two three four five six seven", "en", "s", 1), (12, "ONE two three four five six seven", "en", "s", 1),
]
#: Input columns whose names clash with result columns and inner ones.
CLASH = ("keep_id", "kept", "score", "n_shingles", "size", "taken", "row", "sequence_id", "offset", "start", "node", "data", "digest", "text_sha256", "target", "copies", "id", "n", "token")


def odd(spark, clash=False):
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]) if clash else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# --- exact dedup


def brute_groups(data):
    norm = [re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in data]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    out = Counter()
    for t, own in groups.items():
        own.sort(key=lambda i: (data[i][0] is None, data[i][0] or 0))
        keep = data[own[0]][0]
        for n, i in enumerate(own):
            out[(data[i][0], keep, len(own), n == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_groups(spark, support):
    assert rows(exact_dedup.exact_groups(odd(spark), support)) == brute_groups(ODD)
    assert rows(exact_dedup.exact_groups(odd(spark, True), support)) == brute_groups(ODD)
    kept = exact_dedup.exact_dedup(odd(spark, True), support)
    assert kept.columns == odd(spark, True).columns and kept.count() == sum(n for k, n in brute_groups(ODD).items() if k[3])
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_heavy_hitters_are_verified(spark):
    data = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    keyed = df.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest"))
    winners = exact_dedup.heavy_winners(keyed, 0.01).collect()
    assert [(w.keep_id, w.group_size, w.winners) for w in winners] == [(0, 1000, 1)]
    assert rows(exact_dedup.exact_groups(df, 0.01)) == brute_groups(data)


# --- components and near duplicates


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(data):
    sets = {}
    for i, text in data:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near(spark, data):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 14)))) for i in range(300)]
    data += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b C d e"), (1004, "a B c d E")]
    assert near(spark, data) == brute_near(data)


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", 40)
    rng = random.Random(6)
    base = [f"v{rng.randint(0, 500)}" for _ in range(150)]
    data = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            words[rng.randrange(150)] = f"m{rng.randint(0, 9999)}"
        data.append((i, " ".join(words)))
    data += [(i, " ".join(base[20:80] + [f"q{rng.randint(0, 99999)}" for _ in range(rng.choice([5, 15, 20, 40]))])) for i in range(300, 360)]
    assert near(spark, data) == brute_near(data)


def test_strays_meet_the_others_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", 8)
    sent, stray_links, compare = [], near_dup._stray_links, near_dup.cut

    def seen(rows, links):
        monkeypatch.setattr(near_dup, "cut", lambda df: (sent.append(1), compare(df))[1])
        return stray_links(rows, links)

    monkeypatch.setattr(near_dup, "_stray_links", seen)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    data = [(i, " ".join(passage + [f"q{i // 2}x{k}" for k in range(rng.choice([20, 24, 30]))])) for i in range(60)]
    assert near(spark, data) == brute_near(data)
    assert len(sent) > 2


def test_near_duplicates_of_many_copies_and_a_common_passage(spark):
    copy = " ".join(f"c{i}" for i in range(30))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = spark.range(100_000).select("id", F.lit(copy).alias("text"))
    own = spark.range(100_000, 102_000).select("id", F.concat(F.lit(passage), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("u"), F.col("id") % 1000, F.lit("x"), k)), " ")).alias("text"))
    got = near_dup.near_components(rows.union(own).withColumnRenamed("id", "doc_id"))
    found = {r.component_id: r.n for r in got.groupBy("component_id").agg(F.count("*").alias("n")).collect()}
    assert found == {0: 100_000, **{100_000 + i: 2 for i in range(1000)}}


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    near_text = lambda w: " ".join([f"n{i}" for i in range(40)] + [w])
    data = [(1, near_text("a")), (5, near_text("b")), (5, "something else entirely here now ok"), (None, near_text("c")), (None, "another thing that stands alone here"), (1, near_text("a")), (1, near_text("d"))]
    kept = Counter((r.doc_id, r.text) for r in near_dup.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert sum(n for (_, t), n in kept.items() if t.startswith("n0 ")) == 1 and [i for (i, t) in kept if t.startswith("n0 ")] == [1]
    assert kept[(5, "something else entirely here now ok")] == 1 and kept[(None, "another thing that stands alone here")] == 1 and sum(kept.values()) == 3


def test_near_duplicates_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_components(odd(spark, True)).collect()}
    assert (3, 0, 3) in got and (12, 3, 11) in got and (2, 1, 1) in got and (7, 1, 1) in got and (None, 1, 1) in got
    kept = near_dup.near_dedup(odd(spark, True))
    assert kept.columns == odd(spark, True).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 8, 9, 10, 11])
    assert near_dup.near_components(empty(spark)).count() == 0


def test_light_and_heavy_rules():
    for p in range(1, 40):
        for q in range(1, 40):
            need = near_dup.needed_overlap(p, q)
            assert 100 * need >= 75 * (p + q - need) and not 100 * (need - 1) >= 75 * (p + q - need + 1)
    assert near_dup.choose_boundary({1: 10, 2: 10, 3: 10, 50: 5}) >= 3 and near_dup.choose_boundary({}) >= 1


def test_long_lists_stream_in_batches():
    import pandas as pd

    token, node = np.repeat(np.arange(5), [3, 40, 1, 12, 10]), np.concatenate([np.arange(n) for n in (3, 40, 1, 12, 10)])
    whole = lambda parts: Counter(map(tuple, pd.concat(list(near_dup._lists(iter(parts))))[["kind", "a", "b", "hits"]].groupby(["kind", "a", "b"]).sum().reset_index().to_numpy().tolist()))
    one = whole([pd.DataFrame({"token": token, "node": node})])
    for size in (1, 7, 13):
        assert whole([pd.DataFrame({"token": token[i : i + size], "node": node[i : i + size]}) for i in range(0, len(token), size)]) == one
    assert sum(k[0] for k in one) == 52


# --- packing and token output


def test_best_fit_decreasing_against_a_plain_scan():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 120))]
        rooms, want = [], {}
        for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [r for r in rooms if r[0] >= lengths[k]]
            best = min(fit, key=lambda r: r[0], default=None)
            if best is None:
                best = [40]
                rooms.append(best)
            best[0] -= lengths[k]
            want[k] = best[0]
        window, offset = packing.best_fit_decreasing(lengths, 40)
        assert len(set(window)) == len(rooms) and {k: 40 - offset[k] - lengths[k] for k in want} == want


def check_plan(spark, plan, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    want = Counter()
    for r in data:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            piece = np.array(ids[s : s + 2048], dtype="<u4")
            want[(r[0], s, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    got = plan.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing(spark):
    check_plan(spark, packing.pack(odd(spark)), ODD)
    check_plan(spark, packing.pack(odd(spark, True)), ODD)
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_plan(spark, packing.pack(spark.read.parquet(f"{SF}/documents.parquet")), data)
    assert packing.pack(empty(spark)).count() == 0


def test_token_output_round_trip(spark):
    back = token_output.round_trip(odd(spark, True), shard=3)
    check_plan(spark, back, ODD)
    assert back.where("not positions_ok").count() == 0 and token_output.round_trip(empty(spark)).count() == 0


def test_word_encoder_equals_whole_text_encoding():
    encoder = tokens.WordEncoder(tokens.tokenizer_path(), budget=4000)
    texts = ["", "  ", "a\x1cb\xa0c d", "İstanbul ΣΑΣ ς ÀÉß Éa", "é ́x", "it's we'll DON'T 12 34.5 !!!??", "foo<|endoftext|>bar", "x" * 200 + " y", "日本 語", "\x85a b", "Great!! (so) a/b c\\d |x|"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("aZé'.,!# \n\t9<|>ÜΣ") for _ in range(60)) for _ in range(300)]
    for t in texts:
        want = np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode_texts(pa.array([t]))[0].astype("<u4").tobytes() == want, t
    ids, ends = encoder.encode_texts(pa.array([None, *texts, None]), end_id=7)
    for t, own in zip(["", *texts, ""], np.split(ids, ends[:-1]), strict=True):
        assert own.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [7]
    assert encoder.cache.bytes <= 4000 and len(encoder.encode_texts(pa.array([], "string"))[1]) == 0


# --- quality


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    aside = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.quality for r in aside]) >= 0.95
    assert np.mean([r.predicted for r in aside if r.quality == 1]) >= 0.98


def test_quality_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    got = quality.score_documents(odd(spark, True), labels).collect()
    assert len(got) == len(ODD) and all(r.score == pytest.approx(0.5) for r in got)
    assert quality.score_documents(empty(spark), labels).count() == 0
    kept = quality.keep_quality(odd(spark, True), labels)
    assert kept.columns == odd(spark, True).columns and kept.count() == len(ODD)
    assert {r.score for r in kept.select("score").collect()} == {"clash"}


def test_training_rows_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(400 if i % 3 else 4000)) + (" good" if i % 2 else " bad"), "en", "s", 1) for i in range(120)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), sum(map(len, x)))) or quality.Model(np.zeros(quality.BUCKETS + 1), np.ones(quality.BUCKETS), 1.0, 0.0))
    for most in (200_000, 10**9):
        quality.train(docs, labels, max_bytes=most)
    assert 0 < 4 * seen[0][1] <= 200_000 and 80 < seen[1][0] <= 120


def test_scores_against_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)

    def plain(text):
        x = sorted(set(quality.features((text or "").encode()).tolist()))
        size = np.sqrt(sum(float(model.square[i]) for i in x))
        margin = model.bias + (sum(float(model.weight[i]) for i in x) / size if size else 0.0)
        return 1 / (1 + np.exp(-(model.slope * margin + model.shift)))

    for r in quality.with_scores(docs.union(odd(spark)), model).collect():
        assert r.score == pytest.approx(plain(r.text), rel=1e-3, abs=1e-6)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    xs = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(80)]
    y = np.array([int(np.isin(x, range(10)).sum() >= 2) for x in xs])
    ratio = quality.log_count_ratio(xs, y)
    w = quality.dual_coordinate_descent(xs, y, ratio, cost=1.0, passes=2000)

    def objective(w):
        unit = [ratio[x] / np.sqrt(ratio[x] @ ratio[x]) for x in xs]
        share = (y == 1).mean()
        cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        margin = np.array([w[x] @ v + w[-1] for x, v in zip(xs, unit, strict=True)]) * np.where(y == 1, 1, -1)
        return 0.5 * (w @ w) + (cost * np.maximum(0, 1 - margin)).sum()

    best = objective(w)
    for _ in range(200):
        assert objective(w + rng.normal(0, 0.01, len(w)) * (np.arange(len(w)) % quality.BUCKETS < 30)) >= best - 1e-3


# --- HTML


def test_longest_common_subsequence():
    rng = random.Random(1)

    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        own = [x for x, k in zip(a, html_extract.shared_lines(a, b), strict=True) if k]
        rest = iter(b)
        assert all(x in rest for x in own) and len(own) == length(a, b)


PAGE = "<html><body><div class='box'>Top menu of the site</div><div>{}</div><div>Contact us by mail</div></body></html>"


def test_template_lines_go_where_markup_says_nothing(spark):
    texts = ["A first story about birds.", "Another story, about fish.", "The third is about trees."]
    data = [(i, f"http://h.example/a/{i}.html", PAGE.format(t)) for i, t in enumerate(texts)]
    data += [(10, "http://alone.example/x", "<article><h1>T</h1><p>One <b>bo</b>ld &amp;&nbsp;x<br>two</article><aside>no</aside><div id=comments>no</div><form>no</form>"), (11, None, None), (12, "::", "plain"), (13, "http://e.example/", "<div hidden>no</div><p>yes<script>no")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df.coalesce(1)).collect()}
    assert [got[i][0] for i in range(3)] == texts
    assert got[10][0] == "T One bold & x two" and got[11] == ("", 0) and got[12][0] == "plain" and got[13] == ("yes", 3)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_part_names_do_not_empty_a_page():
    story = "A story about the harbour and its boats."
    for page in ("<form><div><p>{}</p></div></form><nav>x</nav>", "<div class='content no-sidebar'>{}</div>", "<div class='post has-sidebar'>{}</div>", "<div class='legal analysis'>{}</div>",
                 "<div class=review>{}</div>", "<div class='search-engines-explained'>{}</div>", "<div class='post comments-open'>{}</div>", "<div class=comments>{}</div>", "<form><article>{}</article></form><div>other</div>"):
        assert html_extract.main_text(html_extract.page_lines(page.format(story)), []) == story, page
    for page in ("<article>{}</article><div class='comments'><article>" + "no " * 300 + "</article></div><div class='ad-slot-2'>no</div>", "<div>{}</div><form>no</form><div id='cookie-notice'>no</div><aside>no</aside>"):
        assert html_extract.main_text(html_extract.page_lines(page.format(story)), []) == story, page
    assert html_extract.main_text(html_extract.page_lines(f"<article>a card</article><div>{story}</div>"), []) == f"a card {story}"


def brute_extract(data):
    """Every page against the nearest other page of its host on either side, in one sorted list."""
    def key(r):
        bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", r[1] or "")
        return re.split(r"[/?#]", bare)[0].lower(), re.sub(r"(?:/|\.html?)$", "", re.sub(r"^[^/?#]*([^?#]*).*$", r"\1", bare)), r[0] is not None, r[0] or 0

    order, out = sorted(data, key=key), {}
    lines = [html_extract.page_lines(r[2] or "") for r in order]
    for i, r in enumerate(order):
        sides = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(order) and key(order[j])[0] == key(r)[0] and (order[j][2] or "") == (r[2] or ""):
                j += step
            if 0 <= j < len(order) and key(order[j])[0] == key(r)[0]:
                sides.append(lines[j])
        out[(r[0], r[1])] = html_extract.main_text(lines[i], sides)
    return out


@pytest.mark.parametrize("parts", [1, 8, 50])
def test_neighbours_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(parts)
    menu, foot = "<div>Home News Contact</div>", "<div>Written by the desk</div>"
    data = []
    for i in range(160):
        host = rng.choice(["a.example", "b.example", "a.example", "c.example"])
        section = f"<ul><li>Section {i % 3} of the paper</li></ul>"
        data.append((i, f"http://{host}/s{i % 3}/{rng.randint(0, 50)}.html", f"{menu}{section}<div>Story {i} about {rng.random()}</div><p>More of {i}.</p>{foot}"))
    data += [(200 + i, f"http://a.example/s1/25/{i}", data[3][2]) for i in range(90)]  # a run of copies over several ranges
    data += [(400, "http://b.example/s0/0", None), (401, "http://b.example/s0/0", ""), (None, "http://b.example/s0/1", data[5][2]), (402, "http://c.example/long", menu + "".join(f"<p>Line {k} of a long page.</p>" for k in range(20000)) + foot), (7, data[7][1], data[7][2])]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = Counter((r.page_id, r.url, r.text) for r in html_extract.extract(df).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute_extract(data)
    assert got == Counter((r[0], r[1], want[(r[0], r[1])]) for r in data)
    assert not any("Home News" in t or "Written by" in t for _, _, t in got)


def test_pages_articles(spark):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", "\n", inner))
        return " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(line)).strip() for line in inner.split("\n")) if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert np.mean([got[i] == t for i, t in want.items()]) >= 0.99


# --- WARC


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_warc_round_trip(spark, tmp_path, chunk):
    tricky = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "é" * 90
    data = [(1, "http://a/ b\r\nc", tricky), (2, None, tricky), (5, "u", "short"), (4, "u", "short"), (3, "u", None), (6, "u", "é" * 300), (None, "u", "é" * 300), (6, "u", "é" * 300), (7, "u", "y" * 99), (8, "u", "y" * 99)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(0))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk)
    chunks = warc.read_archives(spark, path).collect()
    payloads = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        assert c.chunk_bytes <= max(chunk, 0) or c.record_type == "revisit"
        payloads.setdefault((c.record_id, c.chunk_no), bytes(c.data))
    first = {c.record_id: b"".join(v for (i, _), v in payloads.items() if i == c.record_id) for c in chunks if c.record_type == "response"}
    assert {hashlib.sha256(v).hexdigest() for v in first.values()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, _, t in data}
    got = Counter(tuple(r) for r in warc.page_records(spark.createDataFrame(chunks, warc.CHUNK)).collect())
    want = Counter()
    for i, _, t in data:
        body = (t or "").encode()
        firsts = [x for x, _, u in data if (u or "") == (t or "") and x is not None]
        response = len(body) < 100 or i == min(firsts)
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "response" if response else "revisit", None if response else min(firsts))] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_large_payload_and_segment_order(spark, tmp_path):
    big = "".join(f"{i} é\n" for i in range(700_000))
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", "small")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    chunks = warc.read_archives(spark, path).collect()
    own = sorted((c for c in chunks if c.page_id == 1), key=lambda c: c.chunk_no)
    digest = hashlib.sha256()
    for n, c in enumerate(own):
        digest.update(bytes(c.data))
        assert c.chunk_no == n and c.chunk_bytes <= warc.CHUNK_BYTES and c.running_sha256 == digest.hexdigest() and c.last == (n == len(own) - 1)
    assert digest.hexdigest() == hashlib.sha256(big.encode()).hexdigest() and len(own) > 100
    assert [(c.record_type, c.refers_to, c.payload_bytes) for c in chunks if c.page_id == 2] == [("revisit", 1, len(big.encode()))]
    reader, pieces = warc._Reader(), [r.value.encode() for r in warc.records(pages.where("page_id = 1")).collect()]
    with pytest.raises(ValueError, match="out of order"):
        for piece in (pieces[0], pieces[2]):
            list(reader.feed(piece))


# --- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("name", ["sf0.001", "odd"])
def test_mixing(spark, name):
    docs = odd(spark, True) if name == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).collect()
    text = Counter((r.doc_id, r.source, len(re.findall(r"[^ \t-\r]+", r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == text
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.taken <= 2 * r["size"] and r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    if name != "odd":
        assert all(abs(taken[s] - t) <= max(20, 0.02 * t) for s, t in want.items())
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in again) == Counter((r.doc_id, r.source, r.taken) for r in got)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_small_sources_land_fully_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rng = random.Random(8)
    data = [(i, "w " * rng.randint(3, 7), "en", "a", 1) for i in range(400)]
    data += [(1000 * k + i, "w " * rng.randint(500, 3000), "en", s, 1) for k, s in enumerate("bcde", 1) for i in range(20)]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(data, DOCS)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {s: (taken[s], t) for s, t in target.items() if abs(taken[s] - t) > 60} == {}


def test_mixing_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_flight_keeps_its_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 3000, 500), np.full(500, 0.37)
    q = mixing.flight(p, size, rng, 2)
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size, rel=1e-6)
    mean = np.mean([mixing.flight(p[:40], size[:40], np.random.default_rng(i), 2) for i in range(400)], axis=0)
    assert abs(mean - 0.37).max() < 0.12


# --- nearest neighbours


def brute_nearest(data):
    unit = {}
    for i, v in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, dtype=float)
    cos = lambda a, b: float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
    return {q: sorted(((-cos(unit[q], v), i) for i, v in unit.items() if i != q))[:5] for q in unit if q % 50 == 0}


def test_nearest_small_and_odd(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(120)]
    data += [(150 + i, data[0][1]) for i in range(9)] + [(200, None), (250, []), (300, [0.0] * 8), (301, [None] + [1.0] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    want = brute_nearest(data)
    got = {}
    for r in ann.nearest(df.union(df.where("vec_id = 50"))).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    for q, own in want.items():
        assert [got[q][k + 1][0] for k in range(len(own))] == [i for _, i in own]
        assert [got[q][k + 1][1] for k in range(len(own))] == pytest.approx([-s for s, _ in own], abs=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id in (0, 50)")).count() == 2


def recall(spark, x, **options):
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(df, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(own & set(np.argsort(-(unit @ unit[q]), kind="stable")[1:6].tolist())) for q, own in got.items()]
    assert len(got) == -(-len(x) // 50)
    return sum(hits) / 5 / len(hits)


def test_recall_of_20000_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((300, 32)) * 2
    clustered = centres[rng.integers(0, 300, 10000)] + rng.standard_normal((10000, 32))
    assert recall(spark, np.concatenate([clustered, rng.standard_normal((10000, 32))])) >= 0.9


def test_the_descent_makes_the_graph(spark, monkeypatch):
    monkeypatch.setattr(ann, "BEAM", 16)
    x = np.random.default_rng(4).standard_normal((6000, 24))
    none, some, full = (recall(spark, x, rounds=r) for r in (0, 2, None))
    assert none < 0.4 and none < some < full and full >= none + 0.3


def test_vectors_of_other_lengths_and_more_neighbours(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(a) for a in rng.standard_normal(6)]) for i in range(60)] + [(100, [1.0, 2.0]), (150, [float(a) for a in rng.standard_normal(9)]), (200, [0.0] * 6 + [3.0])]
    data += [(300 + i, data[0][1]) for i in range(14)]
    padded = [(i, v + [0.0] * (9 - len(v))) for i, v in data]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k=12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in padded}
    for q in (0, 50, 100, 150, 200):
        want = sorted((-round(float(unit[q] @ v), 12), i) for i, v in unit.items() if i != q)[:12]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want] and [s for _, _, s in sorted(got[q])] == pytest.approx([-s for s, _ in want], abs=1e-9)


# --- token counts


def test_token_counts_equal_the_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def reference(vocabulary, fallback):
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace()
        return t

    rng = random.Random(3)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(rng.randint(2, 12))}
        vocabulary = [("<unk>", 0.0), *pieces.items()]
        exact, own = reference(vocabulary, False), token_counts.UnigramCounter(vocabulary, budget=4000)
        for _ in range(20):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))
            assert own.text(text) == len(exact.encode(text, add_special_tokens=False).ids), (vocabulary, text)
    import public_tokenizers

    exact = reference(token_counts.read_vocabulary(public_tokenizers.path(token_counts.DEFAULT_VOCABULARY)), True)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd(spark, True)).collect())
    assert got == Counter((r[0], len(exact.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert token_counts.count_tokens(empty(spark)).count() == 0
