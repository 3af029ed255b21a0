"""The training-data operators on text: brute force, held-out accuracy, round trips and awkward rows."""

import os
import random
import re
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pytest

from fathomline.llm import credentials, language, leakage, lookalike, mixing, near_duplicates, residue
from fathomline.llm.credential_lines import Lines

T0 = datetime(2026, 1, 1)
SKILL = "skill_id bigint, description string, when_to_use string, body string, loaded_at timestamp, record_id string"
EMPTY_DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def tagger():
    return credentials.tagger()


# --- 1 ---


def test_tagger_on_held_out_lines(tagger):
    g, right, n = Lines(77), 0, 1500
    for _ in range(n):
        text, marks, before = g.draw()
        right += bool(credentials.spans(text, before, tagger)) == ("s" in marks)
    assert right / n > 0.985


def secret(r, n=24):
    return "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))


def test_lines_found_and_masked(spark, tagger):
    r = random.Random(5)
    a, b, c = (secret(r) for _ in range(3))
    text = f'x = 1\npassword = "{a}"\nurl: postgres://u:{b}@h.example/db\r\nnothing here\n-----BEGIN EC ' + "PRIVATE KEY-----\n" + "Q" * 20 + secret(r, 40) + "\n-----END EC " + f'PRIVATE KEY-----\nparts = "ghp_{c[:12]}" + "{c[12:]}{c}"'
    long = ("word " * 20_000 + "\n") * 2 + f"token: {a}"
    rows = [(1, text, T0, "x"), (1, text, T0, "x"), (1, "old", T0 - timedelta(1), "x"), (2, None, T0, "x"), (3, "", T0, "x"), (None, text, T0, "x"), (4, 'password = "changeme"\napi_key=${KEY}\ntoken: sk_test_' + secret(r), T0, "x"), (5, long, T0, "x")]
    files = spark.createDataFrame(rows, "file_id bigint, file_text string, loaded_at timestamp, record_kind string")
    finds = spark.createDataFrame([(9, f"invocation: x --password {a}", T0), (10, None, T0), (11, "invocation: x --commit " + "0a" * 20, T0)], "finding_id bigint, source string, found_at timestamp")
    got = {(x.record_kind, x.record_id, x.line_no) for x in credentials.credential_lines(files, finds).collect()}
    assert got == {("bundled_file", 1, 2), ("bundled_file", 1, 3), ("bundled_file", 1, 5), ("bundled_file", 1, 8), ("bundled_file", 5, 3), ("finding", 9, 1)}
    red = {x.record_id: x.redacted for x in credentials.redacted_texts(files, finds.limit(0)).collect()}
    assert len(red[1]) == len(text) and not any(s in red[1] for s in (a, b, c[:12], c)) and "postgres://u:" in red[1] and "PRIVATE KEY-----" in red[1]
    assert [x for x, y in zip(text.split("\n"), red[1].split("\n")) if x == y][:2] == ["x = 1", "nothing here"]
    assert credentials.credential_lines(files.limit(0), finds.limit(0)).count() == 0


def test_short_literals_under_any_name_and_single_tokens(tagger):
    for line, at in {"clave: Xk9pQ2zw": 7, "mdp = 'Tr7bVq2m'": 7, "пароль: Zx81kWq7": 8, "密码: Kp94zLm2": 4, "密码：Kp94zLm2": 3}.items():
        assert credentials.spans(line, "", tagger) == [(at, at + 8)], line

    class All:
        """Takes every token for a secret."""

        def tagged(self, lines):
            return [([("chunk", line, 0)], "s") for line, _ in lines]

    body = "q7ZpX2mKc9RtVb4WnYs8HdLf"
    text = f"{body}\n-----BEGIN CERTIFICATE-----\n{body}\n-----END CERTIFICATE-----\n{body}"
    assert [k for k, _ in credentials.scan_text(text, All()) if text.split("\n")[k - 1] == body] == [1, 5]


def test_every_line_is_tagged_as_by_a_search_of_its_own(tagger):
    g = Lines(5)
    drawn = [g.draw() for _ in range(400)]
    together = tagger.tagged([(text, before) for text, _, before in drawn])
    for (text, _, before), (tokens, marks) in zip(drawn, together):
        told, rows = credentials.described(text, before)
        scores = np.array([sum(tagger._sum(role, f) for role, f in groups) for groups in rows])
        best, back = tagger.first + scores[0], []
        for row in scores[1:]:
            x = best[:, None] + tagger.moves
            back.append(x.argmax(0))
            best = x.max(0) + row
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        assert tokens == told and marks == "".join(credentials.LABELS[y] for y in reversed(path))


def test_redaction_leaves_code_whole(tagger):
    import ast

    r = random.Random(9)
    begin, end = "-----BEGIN RSA " + "PRIVATE KEY-----", "-----END RSA " + "PRIVATE KEY-----"
    a, b, short = secret(r, 64), secret(r, 64), "TailSecret12="
    codes = [
        f'key = "{begin}\\n{a}\\n{short}\\n{end}"\nprint(len(key))\n',
        f"key = '''{begin}\n{a}\n{b}\n{short}\n{end}'''\nimportantIdentifierBehind = 1\n",
        f'key = ("{begin}\\n"\n       "{a}\\n"\n       "{short}\\n"\n       "{end}")\n',
        f'key = "{begin}\\n"\nkey += "{a}\\n"\nkey += "{short}\\n" + "{end}"\n',
        f'if "{begin}" in text:\n    someVeryLongIdentifierName = anotherVeryLongIdentifier\n    aNameAsLongAsAKeyLineIs12\n',
        f'note = """\n{begin}\nProc-Type: 4,ENCRYPTED\n\n{a}\n{short}\n{end}\n"""\n',
        f"# {begin}\n# {a}\n# {short}\nvalue = someFunctionWithALongName\n",
    ]
    for code in codes:
        red = credentials.redact(code, credentials.scan_text(code, tagger))
        assert len(red) == len(code) and a not in red and b not in red and short not in red, red
        assert [type(n) for n in ast.walk(ast.parse(red))] == [type(n) for n in ast.walk(ast.parse(code))], red
        for line, masked in zip(code.split("\n"), red.split("\n")):
            if not any(x in line for x in (a, b, short)):
                assert line == masked
        assert credentials.redact(red, credentials.scan_text(red, tagger)) == red


# --- 2 ---


def alike(r, n, base):
    words = list(base)
    for _ in range(n):
        k = r.randrange(len(words))
        words[k : k + 1] = r.choice([[], [f"new{r.randrange(99)}"], [words[k], "more"]])
    return " ".join(words)


def exact(texts, k, least, t):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if len(w) >= least:
            sets[i] = set(zip(*(w[j:] for j in range(k))))
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)  # so that buckets and classes are met in several blocks
    r = random.Random(8)
    texts, n = [], 0
    for fam in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(35, 120))]
        for _ in range(r.randint(1, 9)):
            n += 1
            texts.append((n, alike(r, r.randint(0, 14), base)))
    texts += [(n + k, texts[3][1]) for k in range(1, 12)] + [(900, None), (901, ""), (902, "too short"), (903, texts[0][1].upper() + " ...")]
    df = spark.createDataFrame(texts, "id bigint, text string")
    want = exact(texts, 3, 30, 0.5)
    got = [tuple(x) for x in near_duplicates.Families(df).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {x.id: x.group_id for x in near_duplicates.Families(df).groups().collect()}
    parent = {i: i for i in groups}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert groups == {i: find(i) for i in groups}


def test_estimate_is_corrected():
    r = np.random.default_rng(1)
    a, b = near_duplicates._coefficients(4096)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    y = np.concatenate([x[:200], r.integers(0, 2**63, 100, dtype=np.uint64)])
    sig = [near_duplicates.packed(near_duplicates.minima(s, a, b)) for s in (x, y)]
    got = near_duplicates.estimate_udf.func(__import__("pandas").Series([sig[0]]), __import__("pandas").Series([sig[1]]))[0]
    assert abs(got - 0.5) < 0.05


# --- 3 ---

RESIDUE = ["Hello {{ name }}.", "Made by <YOUR_NAME> for [Your team].", "Version %%V%% and @@X@@", "Lorem ipsum dolor sit amet, elit.", "TODO: describe this", "TBD", "404 Not Found", "Error 500\nInternal Server Error", "Please enable JavaScript to view this page.", "Description coming soon.", "Welcome to undefined!", "Just a moment...", "Fehler 404: Seite nicht gefunden", "Please en​able JavaScript in your browser to continue."]
CONTENT = ["Call it as `{{ name }}`.", "```\n{{ x }} TODO: a\n```", "TODO comments are counted per folder.", 'It skips pages that say "please enable JavaScript" and goes on.', "If the server answers 404 Not Found, wait.", "Undefined or null values are kept.", None, "", "Short.", "x " * 50_000, "~~~\n<YOUR_KEY>\n~~~"]


def test_residue(spark):
    rows = [(k, None, None, x, T0, "c") for k, x in enumerate(RESIDUE)] + [(100 + k, None, None, x, T0, "c") for k, x in enumerate(CONTENT)] + [(0, None, None, "fine", T0 - timedelta(1), "c")]
    calls = [(1, ["python a.py {in}", None], T0), (2, ["python a.py TODO"], T0), (3, ["git diff HEAD@{0}", "mkdir -p a/{b,c}", "cp a ${HOME}/x", "awk '{print $0}' f", "grep TODO f", "curl -s https://a.example/7 -o x"], T0), (4, [], T0), (5, None, T0), (6, ["403 Forbidden"], T0)]
    got = residue.residue(spark.createDataFrame(rows, SKILL), spark.createDataFrame(calls, "report_id bigint, invocations array<string>, loaded_at timestamp"))
    found = {tuple(x) for x in got.collect()}
    assert found == {("skill", k) for k in range(len(RESIDUE))} | {("report", k) for k in (1, 2, 6)}
    assert residue.residue(spark.createDataFrame([], SKILL), spark.createDataFrame([], "report_id bigint, invocations array<string>, loaded_at timestamp")).count() == 0


def test_residue_in_long_lines(spark):
    style = "<style>" + "p{margin:0;padding:0} " * 30 + "</style>"
    prose = "The tool reads each file of the folder once and keeps a small table of what it saw there. " * 6
    long = [
        f"<html><head>{style}<title>404 Not Found</title></head><body><h1>Not Found</h1><p>nginx</p></body></html>",
        f"<!doctype html><html><head>{style}</head><body><noscript>You need to <b>enable JavaScript</b> to run this app.</noscript></body></html>",
        prose + "Please enable JavaScript to view this page. " + prose,
        prose + "TODO: describe the output.",
        '{"error": {"code": 503, "message": "' + "the backend did not answer in time, " * 20 + '"}}',
    ]
    fine = [prose, prose + "A 404 Not Found from the server is retried twice. " + prose, prose + "Pages that need JavaScript are opened in a browser by the tool itself. ", f"<p>{prose}</p><p>{prose}</p>", prose + "На 512 папок сканер потратил меньше минуты. " + prose]
    rows = [(k, None, None, x, T0, "c") for k, x in enumerate(long)] + [(100 + k, None, None, x, T0, "c") for k, x in enumerate(fine)]
    calls = [(1, [long[0]], T0), (2, ["python a.py --note '" + prose + "'"], T0)]
    got = residue.residue(spark.createDataFrame(rows, SKILL), spark.createDataFrame(calls, "report_id bigint, invocations array<string>, loaded_at timestamp"))
    assert {tuple(x) for x in got.collect()} == {("skill", k) for k in range(len(long))} | {("report", 1)}


# --- 7 ---

DISGUISED = {"ｆｕｌｌ": "full", "𝐛𝐨𝐥𝐝": "bold", "ﬁle": "file", "été": "été", "zero​width": "zerowidth", "no break": "no break", "thе word": "the word", "ѕрасеѕ in an English text": "spaces in an english text", "stɑԁy": "stady", "a copy of сору": "a copy of copy", "нaчало": "начало"}
ORDINARY = ["plain", "", "café naïve", "Angles α and β", "Слово отчёт", "\U0001f9d1‍\U0001f4bb and ❤️", "The word отчёт is Russian", "Linuxом", "She sang in the хор, and оса means wasp.", "They say και for and."]


def test_lookalikes(spark):
    for text, want in DISGUISED.items():
        canonical, kinds = lookalike.examine(text)
        assert kinds and canonical == want, text
    for text in ORDINARY:
        assert lookalike.examine(text)[1] == [], text
    assert lookalike.examine(None) == (None, [])
    long = "word " * 40_000 + "​"
    rows = [(1, "a​b", None, "plain", T0, "c"), (1, "old ​", "x y", None, T0 - timedelta(1), "c"), (2, None, long, "", T0, "c"), (None, "​", None, None, T0, "c")]
    df = spark.createDataFrame(rows, SKILL)
    assert {(x.skill_id, x.field_name) for x in lookalike.affected_fields(df).collect()} == {(1, "description"), (2, "when_to_use")}
    assert {(x.skill_id, x.field_name): x.canonical for x in lookalike.canonical_texts(df).collect()}[(1, "description")] == "ab"
    assert lookalike.affected_fields(df.limit(0)).count() == 0


def test_canonical_form_is_stable():
    r = random.Random(3)
    pool = "aZß é́​ｆ аоﬁİ　"
    for _ in range(300):
        once = lookalike.examine("".join(r.choice(pool) for _ in range(12)))[0]
        assert lookalike.examine(once)[0] == once and unicodedata.is_normalized("NFKC", once)


# --- 8 ---


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 300)
    monkeypatch.setattr(leakage, "ITEM_WORDS", 100)
    r = random.Random(6)
    items = [(k, " ".join(f"v{r.randrange(40)}" for _ in range(r.randint(5, 60)))) for k in range(8)] + [(20, None), (21, ""), (22, "a b")]
    docs = []
    for d in range(60):
        w = [f"z{r.randrange(90)}" for _ in range(r.randint(0, 40))]
        if d % 2:
            src = items[r.randrange(8)][1].split()
            n = r.randint(8, 20)
            at = r.randrange(max(1, len(src) - n))
            w[len(w) // 2 : len(w) // 2] = [x.upper() if r.random() < 0.3 else x for x in src[at : at + n]]
        docs.append((d, r.choice([" ", ", ", "\n> "]).join(w), None, "s"))
    docs += [(100, None, None, None), (101, "", None, None), (102, docs[1][1], None, None)]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(k)
    want = {(d, k) for d, t, *_ in docs for w in [words(t)] for i in range(len(w) - 12) for k in grams.get(tuple(w[i : i + 13]), ())}
    df, it = spark.createDataFrame(docs, EMPTY_DOCS.replace("doc_id", "doc_id")), spark.createDataFrame(items, "item_id bigint, item_text string")
    got = leakage.leaks(df, it).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) and want
    text, item = {d: words(t) for d, t, *_ in docs}, {k: words(t) for k, t in items}
    for x in got:
        assert text[x.doc_id][x.doc_word : x.doc_word + x.match_words] == item[x.item_id][x.item_word : x.item_word + x.match_words]
    assert leakage.without_leaks(df, it).count() == len(docs) - len({d for d, _ in want})
    assert leakage.leaks(df, it.limit(0)).count() == 0 and leakage.leaks(df.limit(0), it).count() == 0


def test_suffix_array():
    r = np.random.default_rng(2)
    for n in (1, 2, 50, 300):
        s = r.integers(0, 4, n)
        assert leakage.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


# --- 9 ---


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 2000):
        x = rng.integers(1, 900, n).astype(float)
        pi = np.full(n, 0.37)
        out = mixing.flight(pi, x, rng)
        open_ = ((out > 0) & (out < 1)).sum()
        assert open_ <= 2 and abs(out.sum() - pi.sum()) < 1e-6 and abs((out * x).sum() - (pi * x).sum()) < 1e-4
        assert set(np.unique(mixing.land(out, x))) <= {0.0, 1.0}


@pytest.mark.skipif(not os.path.exists(os.path.join(mixing.TOKENIZERS, mixing.VOCABULARY)), reason="needs the public vocabularies")
def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    drawn_ = mixing.drawn
    monkeypatch.setattr(mixing, "drawn", lambda u, n: drawn_(u, n, 50))
    r = random.Random(2)
    docs = [(k, " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(5, 60))), None, r.choice(["big", "Big ", "BIG"]) if k % 10 else r.choice(["small", "small "])) for k in range(800)]
    docs += [(900, None, None, "big"), (901, "", None, "big"), (902, "no source", None, None)]
    targets = spark.createDataFrame([("m", "big", 0.6, 2, 0.5), ("m", "small", 0.3, 4, 0.5), ("m", "absent", 0.1, 2, 0.5), ("n", "small", 1.0, 3, 0.9), (None, "big", 1.0, 1, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_factor double")
    df = spark.createDataFrame(docs, EMPTY_DOCS)
    got = {(x.mix_id, x.source): x for x in mixing.shares(df, targets).collect()}
    for key in (("m", "big"), ("m", "small")):
        assert abs(got[key].tokens - got[key].goal_tokens) < 200 and not got[key].short
    assert got[("m", "absent")].tokens == 0 and got[("n", "small")].short and got[("n", "small")].most_repeats == 3
    picked = mixing.chosen(df, targets).collect()
    assert len({(x.mix_id, x.doc_id) for x in picked}) == len(picked) and not {x.doc_id for x in picked} & {900, 901, 902}


# --- 10 ---


def test_languages_of_held_out_sentences():
    model = language.train({})
    own = {"en": "When the door is open, everyone should wait outside until they are called.", "de": "Wenn die Tür offen ist, sollen alle draußen warten, bis man sie ruft.", "fr": "Quand la porte est ouverte, il faut attendre dehors que l'on vous appelle.", "es": "Cuando la puerta está abierta, hay que esperar fuera hasta que nos llamen.", "ru": "Когда дверь открыта, нужно ждать снаружи, пока не позовут.", "zh": "门打开的时候，大家都应该在外面等候。", "ja": "ドアが開いているときは、外で待ってください。"}
    for code, s in own.items():
        assert model.classify(s, 0.0)[0] == code, s


def test_other_cyrillic_languages_are_rejected():
    model = language.train({})
    for s in ("Коли двері відчинені, треба чекати надворі, поки не покличуть.", "Когато вратата е отворена, трябва да се чака отвън, докато ви повикат.", "Када су врата отворена, треба чекати напољу док вас не позову."):
        assert model.classify(s)[0] is None, s
    code, confidence = model.classify(language.SEEDS["ru"].split(". ")[2] + ".")
    assert code == "ru" and language.RIVAL_MARGIN <= confidence < 1
    own = [model.classify(x + ".") for x in language.SEEDS["ja"].split("。")[:-1]]
    assert all(c == "ja" and g < 1 for c, g in own)


def test_long_documents_train_too(spark):
    docs = [(1, language.SEEDS["nl"] * 60, "nl", "s"), (2, None, "nl", "s"), (3, "kort", None, "s")]
    got = language.sample(spark.createDataFrame(docs, EMPTY_DOCS))
    assert [len(x) for x in got["nl"]] == [language.SAMPLE_CHARS]


def test_labels_and_sentences():
    assert [language.label_code(x) for x in ("EN", "en-US", "fra", "Spanish", "xx", "", None, "zh_CN", "und")] == ["en", "en", "fr", "es", None, None, None, "zh", None]
    text = '# Title here\n\n```\ncode is here now.\n```\n| a | b | c d e |\nThis is "eine kleine Sache" in a whole sentence.\r\n> Wrapped text that goes\n> on for a while.\n'
    assert [s for s, full in language.sentences(text) if full] == ["This is in a whole sentence. Wrapped text that goes on for a while."] or len([1 for _, f in language.sentences(text) if f]) == 2


def test_mislabelled_documents(spark):
    parts = {c: [x + "." for x in t.rstrip(".").split(". ")] for c, t in language.SEEDS.items() if c in ("en", "de", "fr", "es")}
    docs = [(k, " ".join(parts[c][:5]), lab, "s") for k, (c, lab) in enumerate([("en", "EN"), ("de", "deu"), ("de", "en"), ("fr", None), ("es", "xx"), ("fr", "French")])]
    docs += [(10, " ".join(parts["en"][:3] + parts["de"][:3]), "en", "s"), (11, None, "en", "s"), (12, "", None, "s"), (13, "```\nx\n```", None, "s"), (14, " ".join(parts["de"]) * 300, "de", "s")]
    df = spark.createDataFrame(docs, EMPTY_DOCS)
    got = sorted(tuple(x) for x in language.mislabelled(df).collect())
    assert got == [(2, "de"), (3, "fr"), (4, "es"), (10, "de"), (10, "en")]
    seg = [(x.segment_no, x.lang) for x in language.language_segments(df).filter("doc_id = 10").orderBy("segment_no").collect()]
    assert seg == [(0, "en"), (1, "de")] and all(0 <= x.confidence <= 1 for x in language.document_languages(df).collect())
    assert language.mislabelled(df.limit(0)).count() == 0
