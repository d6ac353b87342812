import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid, linefirst, perspectives, urlcascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


PROSE = "The river ran past the old mill, and nobody said a word about it until the evening.\n"


def test_counts_and_verdicts(spark):
    rnd = random.Random(0)
    good = PROSE + "".join(" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(12)) + ".\n" for i in range(12))
    noise = ["".join(rnd.choices("ab \n\t|#é\x0b\x85", k=200)) for _ in range(20)]
    junk = {"symbols": " ".join(f"w{i}%%%" for i in range(80)), "shout": " ".join(f"LOUD{i}!!" for i in range(80)), "links": "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(30))}
    texts = [good, None, "", "short one.", "again " * 100, *noise, *junk.values(), good + "All rights reserved.\n" + PROSE * 2]
    frame = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in linefirst.clean_lines(frame).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
    assert got[0].kept and not any(got[i].kept for i in (1, 2, 3, 4)) and not any(got[25 + k].kept for k in range(3))
    last = got[len(texts) - 1]
    assert last.kept and last.removed_lines == ["boilerplate", "repeated_line", "repeated_line"] and "rights" not in last.clean_text
    assert linefirst.clean_lines(frame.limit(0)).count() == 0


def test_long_lines_without_an_end_need_marks_inside():
    salad = [f"word{i}" for i in range(120)]
    judge = lambda words: linefirst.judge_line(" ".join(words), words, set())
    assert [judge(salad[:n]) for n in (3, 39, 41, 120)] == [None, "no_end", "no_end", "no_end"]
    prose = [w + "." if i % 12 == 11 else w for i, w in enumerate(salad)]
    assert judge(prose[:119]) is None and judge(prose[:50]) is None and judge([*salad[:119], "end."]) is None
    assert not linefirst.judge_text(" ".join(salad))[6] and linefirst.judge_text(" ".join(prose[:119]))[6]


def plain_kept(text):
    """The verdict, rule by rule, word by word."""
    n, chars, _, _, _, failed = base(text)
    if failed:
        return False
    ends, seen, lost = set(".!?…:;。！？．｡।॥؟۔؛։።፧។၊။།"), set(), 0
    for line in text.split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        stripped = [x.rstrip("\"'”’»)]」』）") for x in w]
        marked = [x[-1:] in ends for x in stripped]
        symbols = sum(c in "#*$%&|<>" for c in line)
        links = len(re.findall(r"[|»›·•>]|\s/\s|\s-\s", line))
        twice = max(sum(a == b for a, b in zip(w, w[1:])), len(w) - 3 * len(set(w)))
        bad = symbols > 0.3 * len(w) + 1 or line in seen
        bad |= len(w) >= 3 and (sum(x.isupper() for x in w) > 0.6 * len(w) or links >= max(3, 0.3 * len(w)))
        bad |= len(w) >= 6 and twice > 0.3 * len(w)
        bad |= len(w) <= 20 and re.search(linefirst.BOILERPLATE, line, re.I) is not None
        thai = 2 * sum("\u0e00" <= c <= "\u0eff" for c in line) >= sum(map(len, w))
        bad |= len(w) >= 4 and not marked[-1] and not thai and (len(w) < 40 or sum(marked) < len(w) // 40)
        seen.add(line)
        lost += sum(map(len, w)) if bad else 0
    return lost <= 0.5 * chars


def test_verdicts_against_a_plain_version():
    rnd = random.Random(9)
    words = ["alpha", "beta", "GAMMA", "LOUD", "x.", "end.", "is", "|", "»", "##", "कमल", "नदी।", "ไทย", "قلم", "سؤال؟", "cookie", "(so.)", "a-b", "/", "-"]
    verdicts = Counter()
    for _ in range(1500):
        some = rnd.sample(words, rnd.randint(2, len(words)))
        text = "\n".join(" ".join(rnd.choice(some) + rnd.choice(["", "", "1", str(rnd.randint(0, 99))]) for _ in range(rnd.choice([2, 5, 9, 25, 45, 90]))) + rnd.choice(["", ".", "।", "؟"]) for _ in range(rnd.randint(1, 7)))
        assert linefirst.judge_text(text)[6] == plain_kept(text), text
        verdicts[plain_kept(text)] += 1
    assert min(verdicts.values()) > 50 and len(verdicts) == 2


def test_clean_texts_of_other_scripts_stay():
    for words, end in (("नदी पुराने पुल के पास से बहती", "।"), ("يمر النهر قرب الجسر القديم والقرية", "؟"), ("แม่น้ำ ไหล ผ่าน สะพาน เก่า และ หมู่บ้าน", "")):
        lines = [" ".join(f"{w}{i}" for w in words.split()) + end for i in range(20)]
        assert linefirst.judge_text("\n".join(lines))[6] and linefirst.judge_text("\n".join(lines))[8] == []
        assert not end or not linefirst.judge_text("\n".join(x.rstrip(end) for x in lines))[6]
    assert linefirst.judge_text("long " * 300_000)[5] and linefirst.judge_text("日" * 1_000_000)[5]


# -- language


def kneser_ney(texts, order=4, discount=0.75):
    """Probability of a code after those before it, by the book: dictionaries of counts, no hashes, no arrays."""
    coded = [tuple(langid.codes(t).tolist()) for t in texts]
    tables = {order: Counter(c[i : i + order] for c in coded for i in range(len(c) - order + 1))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    sums, kinds = {}, {}
    for k, table in tables.items():
        for g, n in table.items():
            sums[k, g[:-1]] = sums.get((k, g[:-1]), 0) + n
            kinds[k, g[:-1]] = kinds.get((k, g[:-1]), 0) + 1

    def p(g):
        k, ctx = len(g), g[:-1]
        below = p(g[1:]) if k > 1 else 2.0**-16
        if (k, ctx) not in sums:
            return below
        weight = discount * kinds[k, ctx] / sums[k, ctx]
        if g in tables[k]:
            return (tables[k][g] - discount) / sums[k, ctx] + weight * below
        return weight * below if k > 1 else below

    return lambda text: -np.mean([np.log2(p(c[max(0, i - order + 1) : i + 1])) for c in [tuple(langid.codes(text).tolist())] for i in range(1, len(c))])


def test_entropies_are_those_of_a_plain_kneser_ney_model(spark):
    rnd = random.Random(7)
    texts = [("".join(rnd.choices("abcdeéß  .", k=rnd.randint(1, 60))), rnd.choice(["aa", "bb"])) for _ in range(60)]
    model = langid.fit(spark.createDataFrame(texts, "text string, lang string").repartition(3))
    for j, lang in enumerate(model.langs):
        plain = kneser_ney([t for t, x in texts if x == lang])
        for t in ("abba cab", "ééß a", "zzz qq", "e", "dabe " * 9, "ΣΑΣ abc"):
            assert abs(model.entropies([t])[0][0][j] - plain(t)) < 1e-4, (lang, t)


def test_models_sum_to_one_and_tell_languages_apart(spark):
    rnd = random.Random(1)
    words = {"aa": ["lumo", "tarek", "onu", "sil"], "bb": ["schraz", "wenn", "dorf", "zuck"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, 40), lang, 0.5) for i in range(120) for lang in [rnd.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", 0.0), (901, "tarek onu", None, 0.0), (902, "", "bb", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(found[i].lang_pred == lang for i, t, lang, _ in rows[:120])
    assert found[900].lang_pred == found[902].lang_pred == "und" and found[900].score == 0 and found[901].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values()) and not any(found[i].rejected for i in range(120))
    assert model.predict(["qqxjvk pfw qqxjvk jjkk xxqv " * 9])[0][3] and model.predict(["123 --"])[0][0] == "und"
    whole = " ".join(words["aa"] * 50)
    for a, b in zip(*(langid.Model.entropies(model, [x])[0][0] for x in (whole, whole + " ")), strict=True):
        assert abs(a - b) < 0.05
    # probabilities after a context sum to one at most (the rest is for letters that were never seen)
    alphabet = sorted({int(c) for t in words["aa"] for c in langid.codes(t)})
    context = langid.codes(" tar")[:-1]
    p = sum(2.0 ** model.log2(np.append(context, c))[-1][0] for c in alphabet)
    assert 0.97 < p <= 1.001
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(docs, max_langs=1)
    # scoring every text once comes to the same as fitting and identifying one after the other
    once = langid.learn_and_identify(docs.withColumn("learns", docs.doc_id % 3 != 0), "learns", "doc_id").collect()
    then = langid.identify(docs, langid.fit(docs.filter("doc_id % 3 != 0"))).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, then)) and len(once) == len(rows)
    odd = docs.withColumn("keep_doc_id", docs.doc_id).withColumn("row", docs.doc_id).union(spark.createDataFrame([(950, "qqxjvk pfw jjkk xxqv " * 20, None, 0.0, 950, 950)], "doc_id long, text string, lang string, score double, keep_doc_id long, row long"))
    for most in (10, 0):
        left = langid.drop_unknown(odd, max_broadcast=most)
        assert left.columns == odd.columns and sorted(r.row for r in left.collect()) == [*range(120), 901]


def test_every_language_has_a_limit_that_follows_its_texts(spark):
    rnd = random.Random(3)
    words = {"aa": ["lumo", "tarek", "onu", "sil", "mena", "rotu"], "cc": ["gwyzz", "phodd", "xyff", "kwabb", "jhupp", "vyngg"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(f"{text('aa', 12)} {i}", "aa") for i in range(6000)] + [("gwyzz phodd xyff kwabb", "cc")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.limits) == {"aa", "cc"} and all(np.isfinite(x) for x in model.limits.values())
    # another text of a language with one text passes, one mostly of letters that it doesn't have fails
    assert [model.predict([text("cc", 30)])[0][i] for i in (0, 3)] == ["cc", False]
    assert [model.predict(["gwccq qxcq cqyyc ffcq kwbbqc " * 9])[0][i] for i in (0, 3)] == ["cc", True]
    assert model.limits["cc"] > model.limits["aa"]
    assert langid.fit(spark.createDataFrame([], "text string, lang string")).limits == {}


def test_pruning_leaves_lower_orders_and_sums_alone(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([("".join(rnd.choices("abcdefghijkl ", k=400)), "aa") for _ in range(40)], "text string, lang string")
    whole, few = langid.fit(docs), langid.fit(docs, max_grams=2200)
    assert len(few.orders[3][0]) < len(whole.orders[3][0]) and len(few.orders[3][0]) > 0
    for k in (0, 1, 2):
        assert (few.orders[k][0] == whole.orders[k][0]).all() and np.allclose(few.orders[k][1], whole.orders[k][1], atol=1e-5)
    counts = {(r.lang, r.gram): r.n for r in langid.count_grams(docs, 4).collect()}
    kept = {int(g) for g in few.orders[3][0]}
    least = min(counts["aa", g] for g in kept)
    assert least > 1 and kept == {g for (_, g), n in counts.items() if n >= least}  # by count alone, no share by hash
    alphabet = sorted({int(c) for c in langid.codes("abcdefghijkl ")})
    context = langid.codes("abc")[1:-1]
    assert 0.97 < sum(2.0 ** few.log2(np.append(context, c))[-1][0] for c in alphabet) <= 1.001


def test_long_texts_are_read_in_pieces(monkeypatch, spark):
    docs = spark.createDataFrame([("lumo tarek onu " * 30, "aa"), ("wenn dorf zuck " * 30, "bb")], "text string, lang string")
    model = langid.fit(docs)
    whole = model.entropies(["lumo tarek " * 50])[0]
    monkeypatch.setattr(langid, "_PIECE", 44)
    assert np.allclose(model.entropies(["lumo tarek " * 50])[0], whole, atol=1e-5)
    text = "ab--" * 20 + "ΑΣ  " + "-" * 100 + "x" * 60 + " "
    for size in (1, 2, 3, 44, 1000):
        monkeypatch.setattr(langid, "_PIECE", size)
        found = [g for c in langid.code_pieces(text, 3) for g in langid.grams(c, 4).tolist()]
        monkeypatch.setattr(langid, "_PIECE", 1 << 20)
        assert found == langid.grams(langid.codes(text), 4).tolist()
    again = langid.fit(docs)
    assert all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in zip(model.orders, again.orders, strict=True))


# -- URL filters


def verdict(url, rules, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for action, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best and best[1], best[0] if best else "block" if any(host == h or host.endswith("." + h) for h in listed if h) else "allow"


def test_urls_against_brute_force(spark):
    rnd = random.Random(2)
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    hosts = ["EXAMPLE.com", "www.example.com", "a.www.example.com", "notexample.com", "spam.net", "x.spam.org", "ok.org", "com", ""]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/es/1', '//', '/e'])}{rnd.choice(['', '?q=/en/', '#x'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "ftp://a://b/en/", "http://spam.net:80/es/"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    named = ["spam.net", "spam.org", "spam.org", "never.seen", "", None]
    listed = spark.createDataFrame([(h,) for h in named], "host string")
    for most in (1 << 20, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlcascade.filter_urls(frame, rules, listed, max_bytes=most).collect()}
        assert got == {i: verdict(u, rules, named) for i, u in enumerate(urls)}
        assert {r.verdict for r in urlcascade.filter_urls(frame, rules, listed.limit(0), max_bytes=most).collect()} == {"allow", "block"}
    assert urlcascade.filter_urls(frame.limit(0), rules, listed).count() == 0


def test_a_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    cascade = urlcascade.build_cascade(universe, error=0.2)
    assert len(cascade.levels) > 2
    rows = universe.select("listed", *urlcascade.hashed(universe.key)).toPandas()
    found = cascade.contains(*(rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))
    assert (found == rows["listed"].to_numpy()).all()
    assert urlcascade.build_cascade(universe, max_bytes=100) is None
    assert urlcascade.build_cascade(universe.filter("not listed")).levels == []


# -- perspectives


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind.", 9), (1, 1, "ann", "Hi <|im_end|>", 9), (1, 2, "bob b", "Yo", 9), (1, 3, None, None, 9), (1, None, "ann", "late", 9), (1, 2, "bob b", "Yo", 9), (2, 0, "system", "alone", 9), (None, 0, "ann", "lost", 9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    for block in (1, 256):
        out = perspectives.rotate_perspectives(frame, block).collect()
        assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob b"), (1, "unknown")} and len(out) == 18
        for who in ("ann", "bob b", "unknown"):
            mine = sorted((r for r in out if r.perspective == who), key=lambda r: r.start)
            whole = "".join(r.segment for r in mine)
            assert [r.end for r in mine] == np.cumsum([len(r.segment) for r in mine]).tolist()
            assert whole.startswith("<|im_start|>system\nBe kind.<|im_end|>\n") and whole.count("<|im_start|>assistant\n") == sum(r.speaker == who for r in mine)
            learned = [whole[r.mask_start : r.mask_end] for r in mine if r.mask_start is not None]
            assert learned == {"ann": ["Hi < |im_end|><|im_end|>", "late<|im_end|>"], "bob b": ["Yo<|im_end|>"] * 2, "unknown": ["<|im_end|>"]}[who]
            if who == "ann":
                assert "<|im_start|>user name=bob_b\nYo<|im_end|>\n" in whole
    assert perspectives.rotate_perspectives(frame.limit(0)).count() == 0


def test_a_host_of_many_labels(spark):
    host = ".".join(["a"] * 50_000) + ".ads.example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/x"), (2, "http://" + "b." * 60_000 + "org/"), (3, "http://ads.example.com/")], "page_id long, url string")
    listed = spark.createDataFrame([("ads.example.com",)], "host string")
    found = urlcascade.filter_urls(pages, [("allow", "org/"), ("block", "net/x")], listed).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == {1: (None, "block"), 2: ("org/", "allow"), 3: (None, "block")}
