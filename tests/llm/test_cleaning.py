import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from landsieve.llm import line_dedup, near_dedup, quality, secrets
from landsieve.llm.components import _to_least, components
from tests.llm.fixtures import DOCS, frame, odd_texts, sentence

BLANK = "[\x20\x09-\x0d]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality rules -----------------------------------------------------------

def measures(text):
    w, text = words(text), text or ""
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k:k + 5]), []).append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_word_measures_match_brute_force(spark):
    texts = [*odd_texts(), "x y x y x y x y x y x y", "a b c d e f a b c d e", "a\na\nb\na", "# * | <b> a&b", "\x0b\x0c\r"]
    got = quality.verdicts(frame(spark, texts, ["kept", "_words"])).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dups, repeats = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_failing_lines_go_and_documents_that_lose_too_much(spark):
    rng = random.Random(3)
    good = "\n".join(sentence(rng) for _ in range(6))
    menu = "Home | News | Sport | Contact | About us"
    shout = "BUY!! NOW!! CHEAP!! GOODS!!"
    loose = "this line has no end mark at all"
    legal = "All rights reserved by the people who own this."
    texts = [good, f"{menu}\n{good}\n{loose}\n{legal}", "\n".join([menu] * 3 + [shout] * 3 + [sentence(rng)]), None, ""]
    docs = frame(spark, texts, ["_q_kept2"])
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(out) == {0, 1} and out[0].text == out[1].text == good
    assert out[1].n_chars == len(good) and quality.clean(docs).columns == docs.columns
    assert quality.clean(docs.limit(0)).count() == quality.verdicts(docs.limit(0)).count() == 0
    rules = dict(spark.createDataFrame([(x,) for x in (menu, shout, loose, legal, good.split("\n")[0])], "l string").select(
        "l", quality.line_fails(F.col("l"))).collect())
    assert list(rules.values()) == ["navigation", "punctuation", "punctuation", "boilerplate", None]


def test_no_python_on_the_main_path(spark):
    docs = frame(spark, ["a"])
    plan = quality.verdicts(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- line windows ------------------------------------------------------------

def without_windows(rows):
    """{(id, text): remaining text} by plain search."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    lines = {r: [x for x in r[1].split("\n") if words(x)] for r in order}
    first, gone = {}, {r: set() for r in order}
    for r in order:
        for at in range(len(lines[r]) - 2):
            key = tuple(lines[r][at:at + 3])
            if key not in first:
                first[key] = (r, at)
                continue
            r1, at1 = first[key]
            begin = max(at, at1 + 3) if r1 == r else at
            gone[r].update(range(begin, at + 3))
    return {r: "\n".join(x for k, x in enumerate(lines[r]) if k not in gone[r]) if gone[r] else r[1] for r in order}


def test_repeated_windows_match_brute_force(spark):
    rng = random.Random(5)
    pool = [sentence(rng, 5) for _ in range(40)]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(60)]
    passage = "\n".join(pool[:4])
    texts += [f"{passage}\n{rng.choice(pool)}" for _ in range(40)] + ["a b\n" * 9, "x\n\n \ny\nz\nx\ny\nz", *odd_texts()]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, passage), (None, texts[4])]
    want = without_windows(rows)
    docs = frame(spark, rows, ["lines", "covered", "key"])
    got = line_dedup.dedup_lines(docs).select("row.doc_id", F.col("row.text").alias("before"), "text", "n_removed", "n_lines").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.before is None:
            assert r.text is None and r.n_removed == 0
        else:
            assert r.text == want[r.doc_id, r.before], r.doc_id
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in got if r.n_removed == 0 or r.n_removed < r.n_lines)
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


# --- near duplicates ---------------------------------------------------------

def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))], sets


def near_rows(seed=7):
    rng = random.Random(seed)
    rows = []
    for size in (1, 1, 2, 3, 8, 420):
        base = [rng.choice("abcdefghij") * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(120)]
        for k in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 5) if k else 0):
                copy[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    chain = [f"c{k}" for k in range(150)]
    rows += [" ".join(chain[k:k + 100]) for k in range(0, 50, 5)]  # neighbours are linked, ends are not
    return list(enumerate([*rows, *odd_texts(), "Same Words here now", "same words HERE now", "three words only", "three words only"]))


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    rows = near_rows()
    rows += [(4, rows[4][1]), (None, rows[5][1]), (None, "no such text anywhere else at all"), (None, None)]
    root, sets = groups(rows, width, 80)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    docs = frame(spark, rows, ["uid", "node", "region", "sig"])
    got = near_dedup.near_duplicates(docs, width=width, keep=["doc_id", "text"]).collect()
    text_of = lambda r: None if r.packed is None else zstandard.decompress(r.packed).decode()
    have = Counter((r.doc_id, text_of(r), r.n_shingles, r.component_id, r.kept) for r in got)
    want = Counter((i, t, len(s), least.get(r) if s else i, i == (least.get(r) if s else i))
                   for (i, t), s, r in zip(rows, sets, root, strict=True))
    assert have == want
    n_groups = len({r for r, s in zip(root, sets, strict=True) if s}) + sum(1 for s in sets if not s)
    one_each = near_dedup.without_near_duplicates(docs, width=width)
    assert one_each.columns == docs.columns and one_each.count() == n_groups == sum(r.first for r in got)


def test_near_duplicates_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.without_near_duplicates(docs).count() == 0


def test_texts_of_no_region_are_left_out_before_the_shuffle(spark):
    """No wanted row is lost, few others stay, and rows are not shuffled for that (op8_lsh_forest)."""
    rows = spark.range(0, 40_000).select(F.col("id").alias("node"), F.lit("text").alias("packed"))
    nodes = spark.range(0, 40_000, 97).select(F.col("id").alias("node"))
    got = near_dedup.only_wanted(rows, nodes)
    found = {r["node"] for r in got.collect()}
    assert found >= set(range(0, 40_000, 97)) and len(found) < 413 + 4_000
    assert near_dedup.only_wanted(rows, nodes.limit(0)).isEmpty()
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_components_take_two_shuffles_a_round(spark):
    """A star step deals its pairs once (op8_lsh_forest)."""
    pairs = spark.createDataFrame([(3, 1), (3, 2), (3, 2), (4, 3)], "a long, b long")
    step = _to_least(pairs)
    assert step._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, step.collect())) == [(3, 1, 1), (3, 2, 1), (4, 3, 3)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    ids = list(range(400))
    rng.shuffle(ids)
    links = [(ids[a], ids[b]) for a, b in links]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    for part in (range(61), range(100, 160), range(200, 202)):
        least = min(ids[k] for k in part)
        assert all(got[ids[k]] == least for k in part)


# --- secrets -----------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def keys(rng, alphabet, n):
    return "".join(rng.choices(alphabet, k=n))


def test_base_spans_match_the_patterns(spark):
    import hashlib

    rng = random.Random(9)
    bits = ["password: hunter22", "ſecret=abcdefgh", "PassWd = 'abc'", 'API_KEY="x1.y2-z3"', "token:tokentoken", "AKIA" + "Q7" * 9,
            "AKIAshort", "deadbeef" * 3, "DEADBEEF" * 3, "é😀", " ", "secret==abcdef", "apikey :  abc/def+gh=", "0123456789abcdef" * 2]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(200)] + odd_texts()
    found = secrets.find_secrets(frame(spark, texts, ["base", "spans"]))
    for r in secrets.digest(found).collect():
        want = base_spans(texts[r.doc_id] or "")
        counts = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_values_after_an_equals_sign_are_tested(spark):
    rng = random.Random(12)
    b62 = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(48, 58)))
    forms = ("AUTH={}", "see https://x.org/a?sig={}&n=1 there", "session={}; path", "auth: {} end", "k=={}", "pad={}==")
    texts, want = [], {}
    for k in range(600):
        value = "".join(rng.choices(b62, k=rng.choice([32, 40]))) + "aZ7"
        form = forms[k % len(forms)]
        start = form.index("{}")
        want[k] = f"random:{start}:{start + len(value) + 2 * form.endswith('==')}"
        texts.append(form.format(value))
    docs = frame(spark, texts)
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    for k, form in enumerate(forms):
        mine = [i for i in want if i % len(forms) == k]
        assert sum(got[i] == want[i] for i in mine) >= 0.9 * len(mine), form
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert all((masked[i] == forms[i % len(forms)].format("[SECRET]").replace("]==", "]")) == (got[i] == want[i]) for i in want)


def test_battery_finds_random_strings_among_ordinary_ones(spark):
    rng = random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = ["getUserAccountByIdentifier{}Handler", "com/example/Project{}/src/main/Resources", "theLongVariableNameOfItem{}Again",
             "Release{}CandidateBuildNotesForTheTeam"]
    texts = [f"see {rng.choice(names).format(rng.randrange(10))} here" for _ in range(300)]
    planted = {}
    for k in range(60):
        secret = keys(rng, b64, rng.choice([32, 40, 44]))
        planted[len(texts)] = secret
        texts.append(f"value é {secret} end")
    docs = frame(spark, texts, ["row"])
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    hits = sum("random:" in got[i] for i in planted)
    false = sum("random:" in s for i, s in got.items() if i not in planted)
    assert hits >= 55 and false <= 3
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns
    clean = {r.doc_id: r for r in masked.collect()}
    some = next(i for i in planted if "random:" in got[i])
    assert planted[some] not in clean[some].text and clean[some].text.startswith("value é [SECRET]")
    assert clean[some].n_chars == len(clean[some].text)
    assert secrets.mask_secrets(docs.limit(0)).count() == secrets.find_secrets(docs.limit(0)).count() == 0


def test_p_values_are_even_for_random_symbols():
    import numpy as np

    rng = np.random.default_rng(4)
    for m, n in ((16, 24), (36, 30), (64, 44), (64, 200)):
        p = np.array([secrets.battery(rng.integers(0, m, n), m) for _ in range(800)])
        assert abs((p < 0.05).mean() - 0.05) < 0.035 and abs((p < 0.5).mean() - 0.5) < 0.15
    assert secrets.battery(np.zeros(30, int), 64) < 1e-6


def test_sentences_of_other_scripts_are_kept(spark):
    """Lines that end in the marks of their own script pass, and their documents with them."""
    lines = {"hindi": "यह एक साफ वाक्य है जो पूरा है और अपने चिह्न पर समाप्त होता है।", "arabic": "هل هذه جملة نظيفة وكاملة تنتهي بعلامتها الخاصة في هذا السطر؟",
             "urdu": "یہ ایک صاف جملہ ہے جو اپنے نشان پر ختم ہوتا ہے اور پورا ہے۔", "japanese": "これは 文 です が 空白 で 分けた 十 語 以上 の 行 です。",
             "chinese": "这 是 一 个 干净 的 句子 用 空格 分开 成 词！", "armenian": "Սա մաքուր նախադասություն է որը ավարտվում է իր նշանով այս տողում կրկին։"}
    rows = quality.rate(frame(spark, list(lines.values()))).select("doc_id", "_q_kept", "_q_lost_chars").collect()
    assert all(r["_q_kept"] and r["_q_lost_chars"] == 0 for r in rows), rows
    bare = quality.rate(frame(spark, [x[:-1] for x in lines.values()])).select("_q_kept").collect()
    assert not any(r["_q_kept"] for r in bare)


def test_no_token_is_left_untested_for_its_alphabet():
    """Tokens that mix separators are tested between them, and of tokens that meet base spans what is left over."""
    value = "Zk3vQ9xT7mB2nL5wR8yP1cD4"
    tested = lambda t: [t[a:b] for _, a, b, *_ in secrets.candidates(t, secrets.base_spans(t))]
    assert tested(f"see /my-path/{value} there") == tested(f"key_{value}/x") == [value]
    assert tested(f"a-b/{value}+{value[::-1]}_z") == [value, value[::-1]]
    assert tested(f"{value}-{value}") == [f"{value}-{value}"] and tested(f"{value}/{value}==") == [f"{value}/{value}=="]
    key = "AKIA" + "ABCDEFGH23456789"
    assert tested(f"{value}-{key}/{value}") == [f"{value}-", f"/{value}"] and tested(f"{value}{key}z") == [value]
    assert tested("some-long/words_without+anything-in/them") == tested(f"a-b/{value[:19]}_c") == tested("") == []
