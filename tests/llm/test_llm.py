"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import html
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagescale import session
from pagescale.llm import crf, curriculum, html_pages, language, latent, line_templates, media, setsketch, toxicity, warc, weak_labels
from pagescale.llm.components import components
from pagescale.session import scratch_names, shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_mix_meets_targets_and_limits(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["a"] * 50 + ["b"] * 5 + ["c"] * 40 + [None] * 3)] + [(3, None, "a"), (4, "", "b"), (4, "", "b")]
    out = curriculum.plan(made(spark, rows)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1 and g.target.iloc[0] <= 3 * g["size"].sum()
    assert abs(sum(g.target.iloc[0] for _, g in out.groupby("source", dropna=False)) - out["size"].sum()) < 1e-6
    order = curriculum.mix(made(spark, rows)).toPandas()
    assert order.words.sum() == out.taken.sum() and order.position.is_monotonic_increasing and order.position.between(0, 1).all()
    assert curriculum.plan(made(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_curriculum_inverse(spark, slope):
    got = spark.range(11).select((F.col("id") / 10).alias("u")).select("u", curriculum.when_reached(F.col("u"), F.lit(slope)).alias("t")).collect()
    for u, t in got:
        assert abs(slope * t * t + (1 - slope) * t - u) < 1e-12


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>" * 700
    rows = [(5, None, long), (2, "http://a\r\nb", long), (9, "u", "x"), (8, "u", "x"), (None, "u", None), (7, "u", ""), (5, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.write_archives(pages, str(tmp_path / "w"), chunk_chars=100).cache()
    assert chunks.groupBy("record").count().where("count > 20").count() == 1  # one response in pieces
    got = sorted(map(tuple, warc.read_records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        again = len(data) >= 100 and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert warc.export_file(chunks, chunks.first().archive, str(tmp_path / "a.warc")) > 0
    assert (tmp_path / "a.warc").read_bytes().startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    reader = warc.RecordReader()
    reader.feed(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    with pytest.raises(ValueError):
        reader.row()


def test_media_round_trip_and_resize(spark):
    texts = [None, "", "a" * 64, "ü" * 1000, "a" * 64]
    got = {r.doc_id: r for r in media.stored(made(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[2].feature == got[4].feature and got[0].media_sha256 == got[1].media_sha256
    image = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.resize(image, 3, 4), image.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.resize(image, 4, 5).mean(), image.mean())


def test_media_decoders():
    assert media.decode(b"P5 # note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]
    assert media.decode(b"P2\n2 1\n9\n3 4\n").tolist() == [[3, 4]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert media.decode(head + b"\x03\x02\x01\x00\x06\x05\x04\x00").tolist() == [[[4, 5, 6]], [[1, 2, 3]]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_match_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = [w if rng.random() > 0.03 else f"x{rng.randrange(999)}" for w in base]
            rows.append((n := n + 1, " ".join(copy).upper() if n % 3 else "\t".join(copy), "s"))
    rows += [(900, None, "s"), (901, " \n", "s"), (902, "a b", "s"), (903, "A  b", "s"), (None, "a b", "s"), (3, rows[2][1], "s")]
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets.setdefault(i, set()).update(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3)) if w)
    root = {i: i for i in sets if i is not None}
    for _ in range(len(root)):
        for a, b in itertools.combinations(root, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[a] = root[b] = min(root[a], root[b])
    got = setsketch.groups(made(spark, rows), words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component == (902 if r.id is None else root[r.id]) and r.n == len(sets[r.id])
    assert setsketch.groups(made(spark, []), words=4).count() == 0


def test_near_groups_hold_few_steps(spark, monkeypatch):
    """All buckets, those of one document too, were written and joined at once, and no step went before the last was done."""
    steps, held = {}, []
    folder = lambda: {x for x in os.listdir(shared_dir(spark)) if x in scratch_names()}

    def written(df, name="step"):
        out = session.cut_lineage(df, name)
        steps.setdefault(name, []).append(out.count())
        held.append({x.rsplit("-", 1)[0] for x in folder() - before})
        return out

    before = folder()
    monkeypatch.setattr(setsketch, "cut_lineage", written)
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    texts += [texts[0] + " one", texts[1] + " two", texts[2], None]
    got = setsketch.groups(made(spark, [(i, t, "s") for i, t in enumerate(texts)]), words=4)
    assert {x.rsplit("-", 1)[0] for x in folder() - before} == {"names", "sets", "labels"}
    assert {(r.id, r.component) for r in got.collect()} == {(i, {30: 0, 31: 1, 32: 2}.get(i, i)) for i in range(34)}
    assert sum(steps["buckets"]) == 32 * setsketch.BANDS and max(steps["buckets"]) < sum(steps["buckets"])
    assert 0 < sum(steps["shared"]) <= 4 * setsketch.BANDS
    assert sum(steps["whole-sets"]) == 4 and len(steps["whole-sets"]) > 1
    assert not any("sketches" in h and "buckets" in h or "buckets" in h and "whole-sets" in h for h in held)


def test_components_keep_the_last_round(spark):
    before = scratch_names()
    got = components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    left = [x for x in scratch_names() - before if os.path.exists(f"{shared_dir(spark)}/{x}")]
    assert len(left) == 1 and {r.component for r in got.collect()} == {0}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 62, 900, dtype=np.uint64), rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    both = np.concatenate([a, b])
    assert (setsketch.registers(both) == np.maximum(setsketch.registers(a), setsketch.registers(b))).all()
    got = setsketch.estimate(setsketch.registers(both)[None], setsketch.registers(a)[None], np.array([1000.0]), np.array([900.0]))
    assert abs(got[0] - 0.9) < 0.08


def test_decontamination(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. The answer is omega psi."), (2, None), (3, " ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda k: " ".join(f"f{k}x{i}" for i in range(300))
    rows = [(10, f"{filler(0)} {items[0][1].upper()} {filler(1)}", "s"), (11, filler(2), "s"), (12, None, "s"), (13, "", "s"), (14, items[0][1].replace("zeta", "sigma"), "s"), (15, "alpha mu omega", "s")]
    assert {r.doc_id for r in latent.contaminations(made(spark, rows), bench).collect()} == {10, 14}
    kept = latent.drop_contaminated(made(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {11, 12, 13, 15} and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert latent.contaminations(made(spark, []), bench).count() == 0
    assert latent.contaminations(made(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_finds_short_items_of_a_large_benchmark(spark):
    r = random.Random(9)
    names = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    text = lambda n: " ".join(names[min(2999, int(r.paretovariate(0.6)))] for _ in range(n))
    docs = [text(200) for _ in range(300)]
    rows, want = [], set()
    for i in range(900):
        doc, n = i % 300, r.randint(8, 15)
        start = r.randint(0, 200 - n)
        rows.append((i, " ".join(docs[doc].split()[start : start + n])))
        want.add((doc, i))
    found = latent.contaminations(made(spark, [(i, t, "s") for i, t in enumerate(docs)]), spark.createDataFrame(rows, "item_id long, text string"))
    assert not want - {(x.doc_id, x.item_id) for x in found.collect()}


def test_common_length():
    a, b = np.array([1, 2, 3, 2, 4]), [2, 9, 3, 4, 2]
    assert latent.common_length(latent.masks_of(a), 5, b) == 3


def test_recurring_lines_go_but_for_the_first(spark):
    word = lambda k, n: " ".join(f"w{chr(97 + k % 26)}{chr(97 + i % 26)}{'abcdefghij'[k // 26 % 10]}{i // 26 * 'z'}" for i in range(n))
    passage = word(30, 60)
    rows = [(i, f"{word(i, 12)}\nPage {i} of 99 in the long report of mister Smith\n{passage}\n{word(i + 100, 15)}", "s") for i in range(6)]
    rows += [(50 + i, f"{word(60, 20)}\n{word(61, 20)}\n{word(62, 9)}", "s") for i in range(5)]  # copies stay
    rows += [(90, None, "s"), (91, "", "s"), (92, "one line", "s")]
    got = {r.doc_id: r for r in line_templates.drop_recurring(made(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[50].dropped == got[53].dropped == 0 and got[90].text is None and got[91].text == ""
    for i in range(1, 6):
        assert got[i].text == f"{word(i, 12)}\n{word(i + 100, 15)}" and got[i].dropped == 2
    assert line_templates.drop_recurring(made(spark, [])).count() == 0


def test_boilerplate_goes_from_documents_of_equal_shape(spark):
    r = random.Random(5)
    line = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    block, small, text = [line(12) for _ in range(20)], [line(12) for _ in range(10)], [line(20) for _ in range(20)]
    own = {i: [line(12), line(12)] for i in range(30)}
    rows = [(i, "\n".join([own[i][0], *block, own[i][1]]), "s") for i in range(30)]
    rows += [(100 + i, "\n".join([*small, line(12)]), "s") for i in range(3)]
    near = {i: [*text[:i], text[i].replace(text[i].split()[1], "edited"), *text[i + 1 :]] for i in range(6)}
    rows += [(200 + i, "\n".join(near[i]), "s") for i in range(6)]
    got = {x.doc_id: x for x in line_templates.drop_recurring(made(spark, rows)).collect()}
    assert got[0].dropped == 0 and all(got[i].text == "\n".join(own[i]) for i in range(1, 30))
    assert [got[100 + i].dropped for i in range(3)] == [0, 10, 10]
    assert all(got[200 + i].dropped == 0 for i in range(6))  # near copies stay


def test_long_lines_go_from_the_second_of_two_documents(spark):
    r = random.Random(6)
    line = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    long, short = line(60), line(10)
    rows = [(i, "\n".join([line(30), long, line(30), short]), "s") for i in range(2)]
    got = {x.doc_id: x for x in line_templates.drop_recurring(made(spark, rows)).collect()}
    assert got[0].dropped == 0 and got[1].text == rows[1][1].replace(long + "\n", "") and got[1].dropped == 1


def test_lines_are_parsed_once_and_copies_leave_nothing(spark, monkeypatch):
    cut, plans, names = line_templates.cut_lineage, {}, []

    def kept(df, name="step"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = cut(df, name)
        names.append((name, out.inputFiles()[0].rsplit("/", 2)[1]))
        return out

    monkeypatch.setattr(line_templates, "cut_lineage", kept)
    same = "the very same line of nine words in it"
    rows = [(i, f"{same}\n" + "\n".join(f"own{i} words{j} of the text a{i} b{j} c d e" for j in range(6)), "s") for i in range(4)]
    got = {r.doc_id: r.dropped for r in line_templates.drop_recurring(made(spark, rows)).collect()}
    assert got[0] == 0 and all(got[i] >= 1 for i in (1, 2, 3))
    assert plans["line-leaves"].count("regexp_replace") == 1  # a filter on the list's size would parse a second time
    left = os.listdir(shared_dir(spark))
    assert not [n for name, n in names if name in ("line-leaves", "line-words", "line-kinds", "line-texts") and n in left]


def test_main_text_on_given_pages_and_odd_html(spark):
    model = html_pages.train()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert html_pages.extract(r.html, model) == " ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", " ", inner)).split())
    assert html_pages.extract(None, model) == html_pages.extract("", model) == html_pages.extract("<script>x", model) == ""
    page = "<nav><a href='/'>Home</a></nav><main><h1>A &amp; B</h1><p>First one, told at some length here.<p>Next one\n follows, and it ends.</main><section class=comments><p>Nice post, thank you.</p></section><footer>&copy; us</footer>"
    assert html_pages.extract(page, model) == "A & B First one, told at some length here. Next one follows, and it ends."
    right = total = 0
    generator = html_pages.Generator(77)
    for _ in range(60):
        found, labels = generator.page()
        text = html_pages.extract(None, model)
        scores = np.array([model.emit[html_pages.numbers(html_pages.features(b, found[i - 1] if i else None))].mean(0) for i, b in enumerate(found)])
        right, total = right + (crf.viterbi(scores, model.start, model.trans) == np.array(labels)).sum(), total + len(labels)
    assert right / total > 0.97 and text == ""


def test_main_text_keeps_what_follows_custom_elements_and_fallback_content():
    model = html_pages.train()
    for tag in ("svg-icon", "object-viewer", "template-part", "script-loader", "style-guide", "iframe-box"):
        page = f"<nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>The first part is told here.</p><{tag} name='x'></{tag}><p>The second part follows, and it ends.</p></article>"
        assert html_pages.extract(page, model) == "A title The first part is told here. The second part follows, and it ends.", tag
    for tag in ("object", "noscript", "canvas"):
        page = f"<article><h1>A title</h1><p>The first part is told here.</p><{tag}><p>A part held by another element.</p></{tag}><p>The second part follows.</p></article>"
        assert html_pages.extract(page, model) == "A title The first part is told here. A part held by another element. The second part follows.", tag
    page = "<body><noscript>Please enable scripts to view this page.</noscript><article><h1>A title</h1><p>The first part <object>with an insert</object> is told here.</p></article><noscript><p>You need scripts for this page.</p></noscript></body>"
    assert html_pages.extract(page, model) == "A title The first part with an insert is told here."
    for tag in ("script", "style", "template", "svg", "SCRIPT"):
        page = f"<article><p>The first part is told here.</p><{tag} a=b>x < y {{}}</{tag}><p>The second part follows.</p></article>"
        assert html_pages.extract(page, model) == "The first part is told here. The second part follows.", tag


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(2)
    scores, start, trans = rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    weight = {p: start[p[0]] + sum(scores[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=4)}
    total = sum(np.exp(x) for x in weight.values())
    marginal, z, _ = crf.forward_backward(scores[None], np.ones((1, 4), bool), start, trans)
    assert np.isclose(z[0], np.log(total))
    for i, y in itertools.product(range(4), range(3)):
        assert np.isclose(marginal[0, i, y], sum(np.exp(x) for p, x in weight.items() if p[i] == y) / total)
    assert tuple(crf.viterbi(scores, start, trans)) == max(weight, key=weight.get)


def test_language_of_code_switched_text():
    parts = {"xx": "kala mala tala sala".split(), "yy": "hort mort fert gurt".split()}
    rng = random.Random(1)
    text = lambda k, n: " ".join(rng.choice(parts[k]) for _ in range(n))
    langs = ["xx", "yy"] * 20
    model = language.fit([text(k, 60) for k in langs], langs, steps=30)
    posterior = language.label([text("xx", 30) + " " + text("yy", 50), None, "12 34"], model, language.Emissions(model))[0]
    assert posterior[0][:28].argmax(1).max() == 0 and posterior[0][32:].argmax(1).min() == 1 and len(posterior[1]) == len(posterior[2]) == 0


def test_language_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(spark, docs)
    out = language.predict(docs.unionByName(made(spark, [(-1, None, "s"), (-2, "", "s"), (-3, "123 !", "s")])), model).toPandas().set_index("doc_id")
    assert (out.lang_pred[[-1, -2, -3]] == "und").all() and out.score.between(0, 1).all()
    held = [i for i in out.index if i >= 0 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert (out.lang_pred[held] == out.lang[held]).mean() > 0.95


def test_toxicity_learns_words_and_misspellings():
    rng = random.Random(3)
    clean = ["lorem", "ipsum", "dolor", "amet", "magna", "vitae", "nulla", "porta", "felis", "risus"] + [f"w{i}ord" for i in range(300)]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "nitwit"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:240], labels[:240], 1 / 3)
    values = toxicity.WordScores(model.weights)
    got = [model.score(toxicity.tokens(t), values) >= 0.5 for t in texts[240:]]
    assert np.mean(np.array(got) == np.array(labels[240:])) > 0.95
    assert values["blockheads"] > 5 * abs(values["lorem"]) and 0 <= model.score([], values) < 0.5


def test_toxicity_holds_words_and_windows_end_to_end():
    """pipeline, driver memory: the fit held an array for every distinct word and for every window."""
    from pagescale.llm import subwords

    words = [f"wo{i}rd" * (i % 3 + 1) for i in range(5000)]
    lists, got = [subwords.buckets(w, 12) for w in words], subwords.word_buckets(words, 12)
    assert got.flat.dtype == np.int32 and [x.tolist() for x in lists] == [got.take(np.array([i]))[0].tolist() for i in range(len(words))]
    held = np.arange(1 << 12) % 3 > 0
    kept = got.where(held)
    assert [x[held[x]].tolist() for x in lists] == [kept.take(np.array([i]))[0].tolist() for i in range(len(words))]
    docs = [np.arange(n, dtype=np.int32) + 100 * n for n in (0, 1, 8, 9, 0, 23, 5)]
    use = np.array([True, True, True, True, True, True, False])
    runs, owner = toxicity.windows(docs, use, 8)
    want = [(d, doc[i : i + 8].tolist()) for d, doc in enumerate(docs) if use[d] for i in range(0, doc.size, 8)]
    assert want == [(d, runs.take(np.array([i]))[0].tolist()) for i, d in enumerate(owner.tolist())]
    none = toxicity.windows([np.zeros(0, np.int32)] * 2, np.ones(2, bool), 8)
    assert none[1].size == 0 and none[0].flat.size == 0 and subwords.word_buckets([], 12).flat.size == 0
    assert toxicity.fit(["", None], [0, 1], 0.5).weights.size == 1 << toxicity.BITS


def test_driver_gets_one_matrix_of_the_passages(spark, monkeypatch):
    """pipeline, driver memory: sixteen matrices of the vocabulary's size came to the driver at once."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(-1, 150, rng.integers(0, 120)).astype(np.int16) for _ in range(60)]
    idf, probe = np.where(np.arange(150) % 7 > 0, rng.random(150) + 0.5, 0.0), rng.normal(size=(150, 6))
    rows = []  # by passage, a block and the next one of the same document
    for words in docs:
        blocks = [words[i : i + latent.STRIDE] for i in range(0, words.size, latent.STRIDE)]
        for i in range(len(blocks)):
            both = np.concatenate(blocks[i : i + 2])
            rows.append(np.bincount(both[both >= 0], minlength=150) * idf)
    a = np.array(rows)
    frame = spark.createDataFrame([(i, w.tobytes()) for i, w in enumerate(docs)], "doc_id long, words binary").repartition(24).persist()
    frame.count()
    kind, sent = type(frame), []
    plain = kind.collect

    def collect(self):
        out = plain(self)
        sent.append(sum(len(r.part) for r in out))
        return out

    monkeypatch.setattr(kind, "collect", collect)
    got = latent.gram_times(frame, probe, idf, np.int16)
    assert np.allclose(got, a.T @ (a @ probe), rtol=1e-4, atol=1e-3)
    assert sum(sent) <= 2 * 4 * probe.size
    assert not latent.gram_times(frame.limit(0), probe, idf, np.int16).any()


def test_toxicity_rows(spark):
    docs = made(spark, [(1, None, "s"), (2, "", "s"), (3, "some words here", "s"), (3, "some words here", "s")])
    out = toxicity.score(docs.withColumn("SCORE_", F.lit(1)), toxicity.fit([], [], 0.1)).collect()
    assert len(out) == 4 and all(0 <= r.score < 0.5 for r in out)


def test_weak_labels_follow_the_truth():
    rng = np.random.default_rng(6)
    truth, counts = rng.random(4000) < 0.8, {}
    wrong = np.array([0.1, 0.05, 0.2, 0.1])
    for y in truth:
        k = ",".join("0" if rng.random() < 0.2 else str(1 if y ^ (rng.random() < w) else -1) for w in wrong)
        counts[k] = counts.get(k, 0) + 1
    posterior, chance = weak_labels.accuracies(counts)
    assert posterior["1,1,1,1"] > 0.95 and posterior["-1,-1,-1,-1"] < 0.05
    assert np.allclose(chance[:, 1, 0] / (chance[:, 1, 0] + chance[:, 1, 2]), wrong, atol=0.08)


def test_weak_label_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(made(spark, [(-1, None, "s"), (-2, "", "s")]))
    scorer, _ = weak_labels.train(docs)
    out = weak_labels.score(docs, scorer).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()
    known = out[out.quality.notna()]
    assert out.score.between(0, 1).all() and ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.9
