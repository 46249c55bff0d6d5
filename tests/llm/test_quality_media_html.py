import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from babelshelf.llm import html, media, quality
from babelshelf.llm.common import cut, shared_path


def brute_posteriors(rows, k_host, k_path):
    center = sum(e for *_, e in rows) / len(rows)
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, e in rows:
        hosts[h].append(e)
        paths[h, p].append(e)
    logit = lambda p: math.log((q := min(max(p, quality.CLIP), 1 - quality.CLIP)) / (1 - q))
    for h, p, e in rows:
        others = (sum(hosts[h]) - e + k_host * center) / (len(hosts[h]) - 1 + k_host)
        site = (sum(paths[h, p]) - e + k_path * others) / (len(paths[h, p]) - 1 + k_path)
        yield site, 1 / (1 + math.exp(-(logit(e) + logit(site) - logit(center))))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_posteriors(request, spark, sf, table, monkeypatch):
    df = request.getfixturevalue(table)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    strengths = iter((7.0, 3.0))
    monkeypatch.setattr(quality, "strength", lambda *_: next(strengths))
    found = quality.classify(df, labels, keep=("source", "lang")).collect()
    assert len(found) == df.count()
    for r, (site, posterior) in zip(found, brute_posteriors([(r.source, r.lang, r.evidence) for r in found], 7.0, 3.0), strict=True):
        assert abs(r.site - site) < 1e-9 and abs(r.posterior - posterior) < 1e-9 and r.kept == (r.posterior >= 0.5)


@pytest.mark.parametrize("levels", [("source",), ("source", "lang", "part"), ("part", "source", "lang", "n_chars")])
def test_any_number_of_levels(spark, sf, documents, monkeypatch, levels):
    """Each level's group shrinks toward the one around it; strengths of the real sums are taken from the widest to the narrowest."""
    found_strengths = []
    real = quality.strength
    monkeypatch.setattr(quality, "strength", lambda *x: found_strengths.append(real(*x)) or found_strengths[-1])
    df = documents.withColumn("part", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 3))
    rows = quality.classify(df, spark.read.parquet(f"{sf}/labels.parquet"), keep=levels, levels=levels).collect()
    assert len(found_strengths) == len(levels) and len(rows) == documents.count()
    center = sum(r.evidence for r in rows) / len(rows)
    groups = defaultdict(list)
    for r in rows:
        for d in range(1, len(levels) + 1):
            groups[tuple(r[c] for c in levels[:d])].append(r.evidence)
    for r in rows:
        site = center
        for d, k in enumerate(found_strengths, 1):
            held = groups[tuple(r[c] for c in levels[:d])]
            site = (sum(held) - r.evidence + k * site) / (len(held) - 1 + k)
        assert abs(r.site - site) < 1e-9


def test_kept_columns_may_clash(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.classify(odd, empty, keep=("kept", "n", "s", "doc_id"))
    assert found.columns == ["doc_id", "evidence", "site", "posterior", "kept", "kept_in", "n", "s", "doc_id_in"]
    assert Counter(map(repr, found.select("doc_id_in", "kept_in", "n", "s").collect())) == Counter(map(repr, odd.selectExpr("doc_id AS doc_id_in", "kept AS kept_in", "n", "s").collect()))


def test_repeated_labelled_ids_send_one_row_each(spark):
    """However often a labelled id or its label repeats, the model is that of its distinct labels."""
    rows = [(i, ("good words in a row " if i % 2 else "### $$$ !!! ") * (1 + i % 7), "s", "l") for i in range(40)]
    labels = [(i, i % 2) for i in range(40)]
    schema, label_schema = "doc_id long, text string, source string, lang string", "doc_id long, quality int"
    plain = quality.train(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, label_schema))
    sent = []
    collect = type(spark.range(0)).toPandas

    def counted(df):
        got = collect(df)
        sent.append(len(got))
        return got

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(0)), "toPandas", counted)
        again = quality.train(spark.createDataFrame(rows + [rows[3]] * 500, schema), spark.createDataFrame(labels * 3, label_schema))
    assert sent == [40] and again == plain


def test_held_out_accuracy(spark):
    """Fitted on even labels, held against odd ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    found = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    got = found.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] >= 0.98 and kept[0] <= 0.15


def test_strength_finds_spread(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        x = rng.binomial(1, rng.beta(6, 4), 50).astype(float)
        rows.append((len(x), float(x.sum()), float((x * x).sum())))
    k = quality.strength(spark.createDataFrame(rows, "n long, s double, ss double"), F.lit(0.6))
    assert 7 < k < 14


def test_no_labels_keeps_all(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, empty).where("NOT kept").count() == 0
    assert quality.classify(none, empty).count() == 0


def test_features_of_odd_texts():
    assert quality.features_of(None) == quality.features_of("") == quality.features_of(" \n") == [0.0] * quality.N_FEATURES
    assert quality.features_of("a a a b")[4] == 0.5


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_media(request, spark, table):
    df = request.getfixturevalue(table)
    found = media.audio_features(cut(media.media_column(df), "test-media"), shared_path(spark, "test-mel")).collect()
    want = defaultdict(int)
    for r in df.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44] += 1
    got, same = defaultdict(int), defaultdict(set)
    for r in found:
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes] += 1
        same[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.n_tensors, r.tensor_crc32, str(r.spans)))
    assert got == want and all(len(x) == 1 for x in same.values())
    r = max(found, key=lambda x: x.n_tensors)
    store, path = pafs.FileSystem.from_uri(r.tensor_file)
    with store.open_input_file(path) as source:
        table = pa.ipc.open_file(source).read_all()
    assert isinstance(table.schema.field("mel").type, pa.FixedShapeTensorType) and table.schema.field("mel").type.shape == [media.SPAN_FRAMES, media.MELS]
    own = table.slice(r.first_tensor, r.n_tensors)
    assert set(own.column("doc_id").to_pylist()) == {r.doc_id} and own.column("start_s").to_pylist()[:2] == [0.0, media.SPAN_FRAMES * media.HOP / media.RATE]


def test_media_empty(spark, none):
    assert media.audio_features(cut(media.media_column(none), "test-media"), shared_path(spark, "test-mel")).count() == 0


def test_resample_keeps_a_tone():
    for source, target in ((16_000, 8_000), (16_000, 12_000), (8_000, 11_000)):
        x = np.sin(2 * np.pi * 440 * np.arange(source) / source).astype(np.float32)
        y = media.resample(x, source, target)
        assert len(y) == target
        spectrum = np.abs(np.fft.rfft(y))
        assert spectrum.argmax() == 440 and 0.8 < spectrum[440] / (target / 2) < 1.2


def test_resample_matches_direct_sum():
    x = np.random.default_rng(0).normal(size=200).astype(np.float32)
    up, down, taps = 3, 4, media.TAPS
    h = media.polyphase_filter(up, down)
    pad = np.concatenate([np.zeros(taps - 1 - taps // 2), x, np.zeros(taps)])
    want = [float(pad[m * down // up : m * down // up + taps] @ h[m * down % up]) for m in range(150)]
    assert np.allclose(media.resample(x, 4, 3), want, atol=1e-5)


def test_segments_hysteresis():
    energy = np.array([0, 0, 5, 0.5, -0.5, 1.0, -5, 0, 0, 9, 9], dtype=np.float32)
    hop = media.HOP / media.RATE
    assert media.segments(energy, 2, 2) == [(2 * hop, 6 * hop), (9 * hop, 11 * hop)]
    assert media.segments(np.zeros(3, np.float32)) == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<div>a <b>bold</b>  \n text</div>", "a bold text"),
        ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>", "- one\n- two\n  - deep\n- three"),
        ("<ol start=3><li>x<li>y</ol>after", "3. x\n4. y\n\nafter"),
        ("<table><tr><th>Name<th>No<tr><td>Ada<td>1<tr><td>Bo<td>22</table>", "Name  No\nAda   1\nBo    22"),
        ("<table><tr><td colspan=2>wide one</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide one\na  b"),
        ("<script>var t='</p>';</script>x<style>p{}</style><!-- no -->y", "xy"),
        ("<head><title>T</title></head><body>b", "b"), ("<html><head><meta charset=x><body>b", "b"),
        ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
        ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
        ("<details><summary>s</summary>no</details>", "s"), ("<details open><summary>s</summary>yes</details>", "s\nyes"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("a<br><br>b", "a\n\nb"), ("1 < 2 &lt; 3", "1 < 2 < 3"),
        ("<dl><dt>t<dd>d</dl>", "t\nd"), ("x<!-- open", "x"), ("</p></div>ok", "ok"), ("a&nbsp;&nbsp;b", "a  b"),
        ("<script>never closed", ""), ("<td>loose</td> cell", "loose cell"), ("<p>a<table><tr><td>c</table>b", "a\n\nc\n\nb"),
    ],
)
def test_html(page, text):
    assert html.visible_text(page) == text


def test_html_deep_and_long():
    assert html.visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html.visible_text("<b>" * 20_000 + "x") == "x"
    assert len(html.visible_text("<p>word " * 50_000)) == 50_000 * 6 - 2


def test_html_keeps_visible_words(spark, sf):
    """Each word outside tags, scripts, styles and comments is there, in order, for pages without hidden parts."""
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(40).collect():
        rest = re.sub(r"(?s)<!--.*?-->|<(script|style|head|noscript|template|title)\b.*?</\1>", " ", r.html)
        if re.search(r"hidden|display|<(svg|select|details)", rest):
            continue
        plain = __import__("html").unescape(re.sub(r"<[^>]*>", " ", rest))
        assert sorted(re.findall(r"\w+", plain)) == sorted(re.findall(r"\w+", re.sub(r"(?m)^(\s*)\d+\. ", r"\1", html.visible_text(r.html)))) or "<ol" in rest


def test_html_rows(spark, none):
    rows = spark.createDataFrame([(1, None, "u"), (None, "<p>a", None), (1, "<p>a", "v")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html.extract_text(rows).collect()) == [(0, "a"), (1, ""), (1, "a")]


@pytest.mark.parametrize("page", ["<a " * 20_000 + "x", "<div>" * 20_000 + "x", "<b>x" * 5000 + "</i>" * 5000, "<ul>" + "<li>x<ul>" * 2000, "<table>" * 2000 + "<td>x", '<a href="y\'>x' * 5000])
def test_odd_pages_take_time_in_proportion_and_keep_their_text(page):
    began = time.perf_counter()
    text = html.visible_text(page)
    assert time.perf_counter() - began < 10 and "x" in text
    if "href" not in page:
        assert text.count("x") == page.count("x")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><meta charset=x>plain <b>text", "plain text"), ("<head><style>p{}</style>\n<div>a</div></head><p>b", "a\n\nb"),
        ("<head><noscript>no</noscript><template>no</template><link rel=x><h1>yes</h1>", "yes"), ("<head>\n<table><tr><td>c</table>", "c"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> holds", "so x=1 holds"),
        ("a<svg>no<title>no</title><desc>no</desc><defs><text>no</text></defs><path d='x'/><text x=1>one</text><g><text>two</text></g></svg>b", "a\none\ntwo\nb"),
        ("<svg><defs/><title/><text>kept</text></svg>after", "kept\nafter"),
    ],
)
def test_html_implied_head_end_and_drawn_text(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize("n", [257, 384, 416, 417, 1000])
def test_each_sample_is_in_a_frame(n):
    x = np.zeros(n, np.float32)
    changed = x.copy()
    changed[-20:] = 0.9
    assert not np.array_equal(media.log_mel(x)[0], media.log_mel(changed)[0])
    assert len(media.log_mel(x)[0]) == 1 + -(-(n - media.FRAME) // media.HOP)
