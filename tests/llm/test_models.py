import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from landsieve.llm import hmm, html_text, top_k
from tests.llm.fixtures import DOCS, frame, odd_texts, sentence

# --- hidden Markov model -------------------------------------------------------


def toy():
    rng = np.random.default_rng(0)
    model = hmm.Model.begin(np.array([5.0, 1, 7, 3, 9]), 3)
    return model, [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 7, 7, 30, 300)]


def by_hand(model, seq):
    a, log = model.start * model.emit[seq[0]], 0.0
    for x in seq[1:]:
        log, a = log + math.log(a.sum()), (a / a.sum() @ model.step) * model.emit[x]
    return log + math.log(a.sum())


def test_likelihood_and_expected_counts(monkeypatch):
    model, seqs = toy()
    assert np.allclose(hmm.score(model, seqs), [by_hand(model, s) for s in seqs])
    short = [s for s in seqs if len(s) <= 7]
    for s in short:  # the sum over all paths
        paths = np.stack(np.meshgrid(*[range(3)] * len(s), indexing="ij"), -1).reshape(-1, len(s))
        p = model.start[paths[:, 0]] * model.emit[s[0], paths[:, 0]]
        for t in range(1, len(s)):
            p = p * model.step[paths[:, t - 1], paths[:, t]] * model.emit[s[t], paths[:, t]]
        assert math.isclose(math.log(p.sum()), hmm.score(model, [s])[0], rel_tol=1e-9)
    whole = hmm.Expected(5, 3)
    whole.add(model, seqs)
    monkeypatch.setattr(hmm, "BLOCK_STEPS", 4)
    monkeypatch.setattr(hmm, "LANES", 2)
    parts = hmm.Expected(5, 3)
    parts.add(model, seqs)
    assert np.allclose(hmm.score(model, seqs), [by_hand(model, s) for s in seqs])
    for name in ("start", "step", "emit", "log"):
        assert np.allclose(getattr(whole, name), getattr(parts, name)), name
    assert math.isclose(whole.emit.sum(), sum(map(len, seqs))) and math.isclose(whole.step.sum(), sum(len(s) - 1 for s in seqs))
    eps = 1e-6
    for i, j in ((0, 1), (2, 2), (1, 0)):  # expected transitions are the slope of the likelihood
        step = model.step.copy()
        step[i, j] += eps
        slope = (hmm.score(hmm.Model(model.start, step, model.emit), seqs) - hmm.score(model, seqs)).sum() / eps
        assert math.isclose(slope * model.step[i, j], whole.step[i, j], rel_tol=1e-3)


def test_one_long_text_does_not_widen_its_neighbours(monkeypatch):
    monkeypatch.setattr(hmm, "LANE_CELLS", 1000, raising=False)
    model, _ = toy()
    seqs = [np.arange(n) % 5 for n in (5000, *range(1, 256))]
    groups = list(hmm.lanes(seqs))
    assert sorted(r for rows, _ in groups for r in rows) == list(range(256))
    assert groups[0][1].shape == (5000, 1) and all(obs.size <= 1000 for _, obs in groups[1:])
    assert np.allclose(hmm.score(model, seqs), [by_hand(model, s) for s in seqs])


def test_training_raises_likelihood(spark):
    model, seqs = toy()
    rows = spark.createDataFrame([(bytearray(s.tobytes()),) for s in seqs], "seq binary").repartition(3)
    logs = []
    for _ in range(6):
        model, log = hmm.expected_counts(rows, model)
        logs.append(log)
    assert all(b > a - 1e-3 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]
    once, log = hmm.expected_counts(rows.coalesce(1), toy()[0], 6)
    assert math.isclose(log, logs[-1]) and np.allclose(once.emit, model.emit)


def test_every_round_sees_all_training_documents(spark, monkeypatch):
    """More documents than any sample would hold, dealt in two ways: same rounds, same model."""
    rng = np.random.default_rng(1)
    seqs = [rng.integers(2, 6, 3).astype(np.uint16) + np.uint16(4 * (k % 2)) for k in range(2600)]
    counts = np.bincount(np.concatenate(seqs), minlength=10).astype(float)
    rows = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(seqs)], "uid long, seq binary")
    met = []
    real = hmm.map_batches
    monkeypatch.setattr(hmm, "map_batches", lambda df, fn, ddl: (met.append(df.count()), real(df, fn, ddl))[1])
    model = hmm.train(rows.repartition(3), counts, 2)
    assert met == [len(seqs)] * hmm.ROUNDS
    want = hmm.Model.begin(counts, 2)
    for _ in range(hmm.ROUNDS):
        found = hmm.Expected(len(counts), 2)
        found.add(want, seqs)
        want = hmm.Model.of(found.start, found.step, found.emit)
    assert np.allclose(model.emit, want.emit) and np.allclose(model.step, want.step)
    again = hmm.train(rows.withColumn("uid", -rows["uid"]).repartition(5), counts, 2)
    assert np.allclose(again.emit, model.emit) and np.allclose(again.step, model.step)


@pytest.mark.parametrize("frequent", [30, 100_000])
def test_scores_of_documents(spark, frequent):
    rng = random.Random(3)
    rows = [*enumerate([*odd_texts(), *[sentence(rng, 60) for _ in range(40)]]), (None, "no id"), (3, "id again")]
    docs = frame(spark, rows, ["uid", "seq", "rare", "word"])
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(w in c for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5))
                  for i, ws in tokens)
    got = hmm.score_documents(docs, states=3, frequent=frequent).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_beats_the_base_on_held_out_text(spark):
    """Two languages whose words do not mix within a document."""
    rng = random.Random(5)
    words = [[f"{side}{k}" for k in range(60)] for side in "ab"]
    docs = frame(spark, [" ".join(rng.choices(words[k % 2], k=50)) for k in range(400)])
    rows = hmm.score_documents(docs, states=4).filter("held_out").collect()
    assert len(rows) > 20 and sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.25 * 50 * len(rows)


def test_scores_without_training_rows(spark):
    assert hmm.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    lone = next(i for i in range(50) if hmm.held_out(i))
    r = hmm.score_documents(frame(spark, [(lone, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


# --- top-k -------------------------------------------------------------------

@pytest.mark.parametrize("big", [1.0, 1e6, 1e8])
def test_block_top_k_matches_brute_force(big):
    rng = np.random.default_rng(1)
    for n, dims in ((1, 1), (30, 4), (700, 8), (700, 1)):
        x = np.floor(rng.normal(size=(n, dims)) * 3 * big).astype(np.int64)
        x[n // 2:] = x[: n - n // 2]  # ties
        ids, q_ids = np.arange(n) * 3, np.arange(0, n, 7) * 3
        a, b, s = top_k.block_top_k(x[::7], q_ids, x, ids, 20)
        got = {}
        for i, j, v in zip(a, b, s, strict=True):
            got.setdefault(int(i), []).append((-int(v), int(ids[j])))
        for i, q in enumerate(q_ids):
            exact = [sum(int(u) * int(w) for u, w in zip(x[i * 7], row, strict=True)) for row in x]
            want = sorted((-v, int(k)) for v, k in zip(exact, ids, strict=True) if k != q)[:20]
            assert sorted(got.get(i, [])) == want


def test_scores_past_a_long_are_cut():
    x = np.array([[2**40, 1], [-(2**40), 5], [3, 4]])
    a, b, s = top_k.block_top_k(x[:1], np.array([0]), x, np.array([1, 2, 3]), 3)
    assert sorted(zip(b.tolist(), s.tolist(), strict=True)) == [(0, 2**63 - 1), (1, -(2**63 - 1)), (2, 3 * 2**40 + 4)]


def test_threshold_stops_before_all_rows_are_met(monkeypatch):
    """One dimension decides: its list's head holds the answer, so the rest stays unread."""
    rng = np.random.default_rng(2)
    x = np.column_stack([np.sort(rng.integers(0, 10**6, 4000)), rng.integers(0, 3, 4000)])
    met = []
    real = np.flatnonzero
    monkeypatch.setattr(top_k.np, "flatnonzero", lambda m: (met.append(int(np.sum(m))) if m.shape == (4000,) else None, real(m))[1])
    top_k.block_top_k(np.array([[1, 0]]), np.array([-1]), x, np.arange(4000), 20)
    assert sum(met) < 1000


def test_embedding_queries_and_odd_vectors(spark):
    rng = random.Random(4)
    nan = float("nan")
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], 0) for i in range(130)]
    rows += [(200, None, 0), (220, [1.0, None], 0), (240, [nan, 1.0], 0), (260, [float("inf")], 0), (None, [1.0], 0), (280, [], 0),
             (300, [0.5, 0.5], 0), rows[7], rows[40], rows[40]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, z int").repartition(3)
    got = {}
    for r in top_k.embedding_top_k(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    f32 = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert set(got) == {i for i in f32 if i % 20 == 0}
    for q, out in got.items():
        dot = lambda a, b: sum(u * w for u, w in zip(a, b))  # noqa: B023, E731
        want = sorted((-dot(f32[q], v), i) for i, v in f32.items() if i != q)[:20]
        assert [(s, i) for _, i, s in sorted(out)] == [(-s, i) for s, i in want]
        assert [r for r, _, _ in sorted(out)] == list(range(1, 21))
    assert top_k.embedding_top_k(table.limit(0)).count() == 0


# --- main text ---------------------------------------------------------------

LABELLED = """<html><head><title>t</title><script>var a="</p><article>";</script></head><body><nav><ul>{menu}</ul></nav>
<div class="ad">Buy the thing now.</div><article><h1>Title {k}</h1>{body}</article><footer>&copy; site</footer></body></html>"""


def labelled(k):
    body = "".join(f"<p>Paragraph {j} of page {k} with quite a few words in it.</p>" for j in range(4))
    return LABELLED.format(menu="".join(f"<li><a href=x>Item {j}</a></li>" for j in range(6)), body=body, k=k)


def test_text_of_labelled_and_other_pages(spark):
    other = """<body><header><h1>Site name</h1></header><ul class=menu><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul>
    <div id="content"><h2>Head &amp; line</h2><p>The first block &nbsp; of\n text, in <b>bold</b> and <i>slanted</i> type.
    <p>A second, not closed<br>after a break.<div class="advert box"><p>Buy this now, it is cheap</p></div>
    <p>The third block comes after an advert and is kept.</p><!-- hidden words --><form>Search <input> here</form>
    <div class="comments"><p>Nice words, dear author, I read them all</p></div></div><aside>Most read today</aside>
    <div id="cookie-notice">We use cookies</div><footer>Imprint</footer><script>x("<p>no</p>")"""
    odd = [None, "", "plain words only", "<p", "<!-- never closed <p>a</p>", "&lt;b&gt; &#233;", "<script>x</script>"]
    pages = [*[labelled(k) for k in range(8)], other, *odd]
    rows = [(k, f"u{k}", p, 1) for k, p in enumerate(pages)] + [(0, "u0", pages[0], 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = {r.page_id: r for r in html_text.page_texts(table).collect()}
    for k in range(8):
        want = [f"Title {k}", *[f"Paragraph {j} of page {k} with quite a few words in it." for j in range(4)]]
        assert got[k].text == "\n\n".join(want)
    assert got[8].text == ("Head & line\n\nThe first block of text, in bold and slanted type.\n\n"
                           "A second, not closed after a break.\n\nThe third block comes after an advert and is kept.")
    assert [got[9 + k].text for k in range(len(odd))] == ["", "", "plain words only", "<p", "", "<b> é", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.page_texts(table).count() == len(rows)
    assert html_text.page_texts(table.limit(0)).count() == 0


def test_pages_without_article_among_labelled_ones_with_plain_words_outside(spark):
    """A date line and a skip link outside the article say nothing against the text of pages made of div alone."""
    stray = "<body><div>Skip to content</div><div>Monday, 3 May</div>"
    plain = ("<body><div class=menu><a href=/>Home</a></div><div><div>The only text of a page of div elements.</div>"
             "<div>Its second block.</div></div><div class=footer>Imprint</div>")
    empty_main = "<body><main></main><div>Words beside an empty main element.</div>"
    whole = [re.sub("<script>.*</script>", "", labelled(k)).replace("<body>", stray) for k in range(30)]
    pages = [*whole, plain, empty_main]
    table = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.page_texts(table).collect()}
    for k in range(30):
        want = [f"Title {k}", *[f"Paragraph {j} of page {k} with quite a few words in it." for j in range(4)]]
        assert got[k] == "\n\n".join(want)
    assert got[30] == "The only text of a page of div elements.\n\nIts second block."
    assert got[31] == "Words beside an empty main element."


def test_best_region_matches_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(0, 12))]
        start, end = html_text.best_region(scores)
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0.0)
        assert math.isclose(sum(scores[start:end]), max(best, 0.0))


def test_weights_follow_the_labels():
    found: Counter = Counter()
    for k in range(20):
        found.update(html_text.counts(labelled(k)))
    w = html_text.weights_from(found)
    assert w["word:article"] > 2 and w["word:menu"] < 0 and w["word:footer"] < 0
    assert w["tag:li"] == html_text.MIN_TAG and all(v < 0 for f, v in w.items() if f.startswith("tag:"))
