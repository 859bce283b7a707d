"""License scans, chat formatting, surrogates and toxicity."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from feedmart.llm import chat as H
from feedmart.llm import licenses as L
from feedmart.llm import pii as P
from feedmart.llm import toxicity as T


def test_license_base_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["gnu", "general", "public", "license", "mit", "Apache", "CC", "by", "é", "x1", "mit license", "apache-license"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(60)))) for i in range(150)] + [(900, None), (901, ""), (901, ""), (902, "mit license " * 8000)]
    got = L.scan_licenses(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, labels string")).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [(k, label) for p, label in L.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_templates():
    scan = L.Scanner(L.PHRASES, L.TEMPLATES).scan
    labels = lambda t: set(scan(t.encode())[5].split(","))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    assert "mit-text" in labels(mit) and "mit-text" in labels(mit.replace("permission notice", "permission notice (including the next paragraph)")) and "mit-text" not in labels(mit.replace("free of charge", "for a charge"))
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-4.0"} and labels("licensed under the Apache License, Version 2.0") == {"apache", "apache-2.0-notice"}
    auto = L.compile_template("a [[b [[c]]]] {{4}} d {{e|f g}}")
    ok = lambda t: auto.longest(L.words_of(t.encode()), 0) is not None
    assert ok("a d e") and ok("a b c x y d f g") and ok("a b 1 2 3 4 d e") and not ok("a b 1 2 3 4 5 6 7 d e") and not ok("a d f")


def test_templates_against_brute_force():
    """Every start and end of random words, against a regular expression over whole words."""

    def pattern(template):
        out = ""
        for m in L._MARK.finditer(template):
            part, inner = m.group(0), m.group(1)
            if part in ("[[", "]]"):
                out += "(?:" if part == "[[" else ")?"
            elif inner is None:
                out += "".join(re.escape(w.decode()) + " " for w in L.words_of(part.encode()))
            elif inner.isdigit():
                out += r"(?:\S+ ){0,%s}" % inner
            else:
                out += "(?:" + "|".join("".join(re.escape(w) + " " for w in x.split()) for x in inner.split("|")) + ")"
        return re.compile(out)

    rng = random.Random(3)
    templates = ["{{2}} a b", "a {{1}} b", "x", "[[a]] b [[c {{a|b c}}]] a", "a [[b]] {{3}} c", "{{|a}} b c", "{{1}} c", "a b {{2|3}} c"]
    for k, template in enumerate(templates):
        scanner, want = L.Scanner({}, {"t": template}), pattern(template)
        for _ in range(60):
            words = rng.choices(["a", "b", "c", "x", "2"], k=rng.randrange(14))
            ends = lambda s: [e for e in range(s, len(words) + 1) if want.fullmatch("".join(w + " " for w in words[s:e]))]
            brute = {("t", s, ends(s)[-1]) for s in range(len(words)) if ends(s)}
            assert {(m["label"], m["first"], m["end"]) for m in scanner.scan(" ".join(words).encode())[7]} == brute, (k, words)


def test_every_template_accepts_its_own_wording():
    for label, template in L.TEMPLATES.items():
        plain = re.sub(r"\{\{(?:\d+|\|?)\}\}", "", template.replace("[[", " ").replace("]]", " "))
        plain = re.sub(r"\{\{([^}]*)\}\}", lambda m: next(x for x in m[1].split("|") if x), plain)
        assert label in L.Scanner(L.PHRASES, {label: template}).scan(f"so {plain} then".encode())[6 - 1].split(","), label


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\<|", "<\\|", "a\\", "\n<|im_start|>assistant\n", "", "é😀"]
    assert all(H.unescape(H.escape(t)) == t and "<|" not in H.escape(t) for t in nasty)
    assert all(H.parse_turn(H.format_turn(r, t)[0]) == (r, t) for t in nasty for r in ("assistant", "odd\nrole\\n<|"))
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, 0, "system", None), (None, 1, None, "x")] + [(3, k, "assistant", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in H.digests(H.format_chats(H.turn_records(df.repartition(5)))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == sum(len(H.format_turn(a, t)[0]) for _, a, t in turns)
    assert H.digests(H.format_chats(H.turn_records(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7}, {"prompt": "q", "completion": "a"},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "more", "output": None}, {"odd": 1}, [1],
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(9, 0, "{broken"), (10, 0, None)], "conv_id long, seq long, record string")
    got = {}
    for r in H.format_chats(df).orderBy("conv_id", "part").collect():
        got.setdefault(r.conv_id, []).append(H.parse_turn(r.formatted) if r.mapping else r.schema_id and "unknown")
    plain = [("user", "q"), ("assistant", "a")]
    assert [got[i] for i in range(4)] == [plain] * 4 and got[4] == [("user", "q"), ("user", "more"), ("assistant", "")]
    assert got[5] == ["unknown"] and got[6] == ["unknown"] and got[9] == [None] and got[10] == [None]


def test_chat_malformed(spark):
    """Whatever a record holds, it gives rows: of its turns, or one of null mapping; and the count of unknown layouts misses none."""
    deep = "[" * 100_000 + "]" * 100_000
    records = ['{"messages":[{"role":"user"},{"role":"assistant","content":"x"}]}', '{"messages":[{}]}', "{}", "[]", '{"messages":[]}', deep, '{"role":"user","text":"\\ud800 x"}', '{"\\ud800":1}', '{"messages[]":{"role":"a","content":"b"}}', "5", "null", '{"role":"user","text":"x","name":"bob","meta":{"k":[1]}}', '{"role":"user","text":["x",1]}', "NaN", '{"role":null,"text":null}']
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv_id long, seq long, record string")
    out = H.format_chats(df).cache()
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {*range(len(records))} == {r.conv_id for r in out.collect()}
    known = {i for i, r in got.items() if r.mapping}
    assert known == {6, 11, 14} and H.parse_turn(got[6].formatted) == ("user", "\ufffd x") and H.parse_turn(got[11].formatted) == ("user", "x")
    assert sum(r.n for r in H.unknown(out).collect()) == len(records) - 3 and H.digests(out).count() == 3


def test_turn_records_use_several_layouts(spark):
    df = spark.createDataFrame([(i, k, r, f"t{i}{k}") for i in range(40) for k, r in enumerate(["user", "assistant", "human", "gpt", "system"])], "conv_id long, turn long, role string, text string")
    out = H.format_chats(H.turn_records(df)).collect()
    assert len({r.schema_id for r in out}) == 4 and {(r.conv_id, r.seq, *H.parse_turn(r.formatted)) for r in out} == {tuple(r) for r in df.collect()}


PRIVATE = [
    (1, "Mail Anna.Berg@Mail.example.com or call +1 (136) 555-7479, 10.1.2.3; card 4111111111111111."), (2, "again anna.berg@mail.example.com and +1-136-555-7479, 4111 1111 1111 1111"),
    (3, 'token = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1" password=a9ce335683f9'), (4, "Mrs. Anna Berg met Mr Karl Berg and Mr. BERG; г-жа Анна Петрова"), (5, "nothing 12 here, v1.2.3"), (6, None), (7, ""), (5, "nothing 12 here, v1.2.3"), (None, "x@y.example.org"), (8, "plain " * 30_000 + "z@y.example.org"),
]


def test_surrogates(spark):
    df = spark.createDataFrame([(*r, "c", "c") for r in PRIVATE], "doc_id long, text string, kind string, mentions string")
    rows = P.surrogates(df, "k").collect()
    assert len(rows) == len(PRIVATE)
    got = {r.doc_id: r for r in rows}
    made = lambda i, kind: [m.surrogate for m in got[i].mentions if m.kind == kind]
    for r in rows:  # what stands between mentions is untouched, and places are those of the given text
        given = next(t or "" for i, t in PRIVATE if i == r.doc_id)
        at, out = 0, ""
        for m in r.mentions:
            out, at = out + given[at : m.start] + m.surrogate, m.start + m.length
        assert out + given[at:] == r.text
    assert got[1].kinds == "card,email,ip,phone" and got[5].n_mentions == 0 and got[6].text == "" and got[8].n_mentions == 1
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(made(1, "phone")[0]) == digits(made(2, "phone")[0]) != "11365557479" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", made(1, "phone")[0])
    assert made(1, "email")[0].lower() == made(2, "email")[0] and made(1, "email")[0].endswith(".com")
    card = digits(made(1, "card")[0])
    luhn = sum(d - 9 if d > 9 else d for d in (int(c) * (2 if (len(card) - k) % 2 == 0 else 1) for k, c in enumerate(card))) % 10
    assert card == digits(made(2, "card")[0]) and luhn == 0 and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", made(2, "card")[0])
    assert re.fullmatch(r'token = "[0-9a-f]{40}', made(3, "secret")[0]) and made(3, "secret")[1].startswith("password=")
    a, b, c, d = made(4, "person")
    assert a.startswith("Mrs. ") and a.split()[1].endswith("lina") and b.split()[1].endswith("nus")
    assert a.split()[2] == b.split()[2] and c == f"Mr. {a.split()[2].upper()}" and re.fullmatch(r"г-жа [А-я]+ [А-я]+", d)
    again = {r.doc_id: r.text for r in P.surrogates(df.repartition(3), "k").collect()}
    assert again == {r.doc_id: r.text for r in rows} and P.surrogates(df.filter("doc_id = 1"), "other").first().text != got[1].text
    assert P.surrogates(df.limit(0), "k").count() == 0


def test_surrogates_of_all_kinds(spark):
    """Scripts, unknown gender, names that recur alone, national numbers, accounts, capital hexadecimals."""
    rows = [
        (1, "Mr John Smith called. Smith left. John agreed, SMITH too; Smithson did not."), (2, "κυρία Άννα Παπά και κύριος Γιώργος Παπάς; ο Γιώργος"), (3, "Mr 王小明 spoke, then 王小明 left"), (4, "Dr. Ada Smith and Dr Ada"),
        (5, "call (555) 123-4567 or 555-123-4567, id 555-12-3456, version 1.2.3-4"), (6, "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000 now"), (7, "secret: 3FDF5A35C7B8D733C0B5"), (8, "Smith alone, John alone"),
    ]
    got = {r.doc_id: r for r in P.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    text = lambda i: got[i].text
    first, last = re.fullmatch(r"Mr ([A-Z][a-z]+nus) ([A-Z][a-z]+rel) called\. \2 left\. \1 agreed, [A-Z]+REL too; Smithson did not\.", text(1)).groups()
    assert last.upper() in text(1) and text(8) == rows[7][1] and text(4).split()[2] == last and re.fullmatch(r"Dr\. ([A-Z][a-z]+ris) [A-Z][a-z]+rel and Dr [A-Z][a-z]+(?:ris|rel)", text(4))
    assert not re.search("[A-Za-z]", text(2)) and "Παπ" not in text(2) and re.search(r"κύριος (\w+νος) \w+ρελ; ο \1$", text(2))
    assert re.fullmatch(r"Mr (\w{1,4}) spoke, then \1 left", text(3)) and "王" not in text(3)
    m = re.fullmatch(r"call \((\d{3})\) (\d{3})-(\d{4}) or (\d{3}-\d{3}-\d{4}), id (\d{3}-\d{2}-\d{4}), version 1\.2\.3-4", text(5))
    assert "-".join(m.groups()[:3]) == m[4] != "555-123-4567" and m[5] != "555-12-3456"
    a, b = re.fullmatch(r"pay ([A-Z0-9 ]+) or ([A-Z0-9]+) now", text(6)).groups()
    assert a.replace(" ", "") == b != "DE89370400440532013000" and len(a) == 27 and b.startswith("DE") and int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1
    assert re.fullmatch("secret: [0-9A-F]{20}", text(7)) and text(7) != rows[6][1]
    for i, given in rows:
        at, out = 0, ""
        for m in got[i].mentions:
            out, at = out + given[at : m.start] + m.surrogate, m.start + m.length
        assert out + given[at:] == text(i)


def test_long_secrets_go_whole(spark):
    """No part of a long key stays, and keys that agree in their first 128 characters stay distinct."""
    rng = random.Random(9)
    head = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNP23456789+/_-") for _ in range(400))
    keys = [head, head[:128] + head[:200], head[:128] + head[200:], "0123456789abcdef" * 40]
    rows = [(i, f"api_key = '{k}' ends here") for i, k in enumerate(keys)]
    got = {r.doc_id: r for r in P.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    values = [re.fullmatch(r"api_key = '([^']*)' ends here", got[i].text)[1] for i in range(len(keys))]
    for i, (key, value) in enumerate(zip(keys, values, strict=True)):
        assert len(value) == len(key) and got[i].n_mentions == 1 and got[i].mentions[0].length == len(key) + len("api_key = '")
        assert not any(key[at : at + 16] in got[i].text for at in range(len(key) - 15))
    assert len(set(values)) == len(keys)


def test_surrogates_stay_distinct(spark):
    """More entities than one attempt tells apart: addresses and short names collide and are given anew."""
    names = [(f"last latin", f"n{i}") for i in range(3000)]
    got = P.assign(spark.createDataFrame(names, "kind string, canonical string"), "k").collect()
    assert len(got) == 3000 and len({r.surrogate for r in got}) == 3000


def test_block_max_equals_brute_force():
    rng = np.random.default_rng(6)
    n, terms = 700, 60
    dense = np.where(rng.random((n, terms)) < 0.08, rng.random((n, terms)) + 0.01, 0.0)
    dense[650:] = dense[600:650]  # ties
    at = np.nonzero(dense)
    for block, common in ((16, 0), (16, 5), (64, 60), (1000, 5)):
        index = T.BlockMaxIndex((dense > 0).sum(axis=1), at[1], dense[at], rng.permutation(n), terms, block, common)
        queries = [(np.flatnonzero(q), q[q > 0]) for q in dense[::9]] + [(np.empty(0, np.int64), np.empty(0))]
        for (t, w), got in zip(queries, index.search(queries, 15), strict=True):
            brute = np.round(dense[:, t] @ w, 12) if len(t) else np.zeros(n)
            want = [(float(brute[e]), int(e)) for e in np.lexsort((np.arange(n), -brute))[:15] if brute[e] > 0]
            assert [e for _, e in got] == [e for _, e in want] and all(abs(a - b) < 1e-10 for (a, _), (b, _) in zip(got, want, strict=True))


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        text = rng.choices(words, k=rng.randrange(5, 80)) + (rng.choices(["vileness", "nastily", "scumbag"], k=3) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text).title() if i % 3 else " ".join(text)))
        if i % 10 < 7:
            marks.append((i, int(toxic)))
    truth = {i: int("vil" in t.lower() or "nastily" in t.lower() or "scum" in t.lower()) for i, t in rows}
    rows += [(5000, None), (5001, ""), (None, "vileness scumbag vileness"), (3, rows[3][1]), (5002, "calm " * 40_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([*marks, (None, 1), (9999, 1), (1, None)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == truth.get(r.doc_id, 0) for r in held) >= 0.98 * len(held)
    assert next(r for r in got if r.doc_id is None).predicted == 1 and next(r for r in got if r.doc_id == 5002).predicted == 0
    used = {e.doc_id for r in got for e in r.evidence}
    held_ids = {r.doc_id for r in held}
    assert used and not used & held_ids
    bare = T.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0]
    assert bare == 0.0 and T.toxicity(docs.limit(0), labels).count() == 0


def brute_votes(examples, texts, n_all, df_all, k=15):
    """Vote and nearest examples of each text, by dictionaries alone; ``examples`` has (id, label, words with counts)."""
    n, bad = len(examples), sum(y for _, y, _ in examples)
    held, toxic = T.Counter(), T.Counter()
    for _, y, c in examples:
        held.update(c.keys())
        toxic.update(c.keys() if y else ())

    def weight(w):
        idf = math.log((1 + n_all) / (1 + (df_all[w] if w in held else 0))) + 1
        if w not in held:
            return idf
        a, b = toxic[w] + 0.5, held[w] - toxic[w] + 0.5
        z = max(0.0, math.log(a / (bad + 1) * (n - bad + 1) / b) / math.sqrt(1 / a + 1 / b))
        return idf * (1 + z * z)

    weights = {w: weight(w) for c in [*(c for _, _, c in examples), *texts] for w in c}
    unit = lambda c: (lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()})({w: (1 + math.log(m)) * weights[w] for w, m in c.items()})
    vectors = [(i, y, unit(c)) for i, y, c in examples]
    out = []
    for c in texts:
        q = unit(c)
        near = sorted((-round(sum(x * v[w] for w, x in q.items() if w in v), 9), i, y) for i, y, v in vectors)[:k]
        near = [(-s, i, y) for s, i, y in near if s < 0]
        votes = [(1 / (1.05 - min(1.0, s)), y) for s, _, y in near]
        out.append(((bad / n + sum(v * y for v, y in votes)) / (1 + sum(v for v, _ in votes)), near))
    return out


def rising(x, y):
    """Isotonic fit at each point by the min-max rule."""
    order = np.argsort(x, kind="stable")
    z = np.array(y, float)[order]
    fit = np.array([max(min(z[i : j + 1].mean() for j in range(k, len(z))) for i in range(k + 1)) for k in range(len(z))])
    return np.array(x)[order], fit


def test_toxicity_equals_brute_force(spark):
    """Words, document frequencies over all rows, ties of words to the label, neighbours, votes and calibration, by plain Python."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices([f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(120)], k=rng.randrange(1, 25))) + (" vileness scumbag" if i % 7 == 0 and i % 3 else "")) for i in range(160)]
    odd = " ".join(f"zz{chr(97 + j)}qu" for j in range(20))
    rows += [(900, odd), (901, odd), (902, ""), (903, None), (904, "unseen words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows if i < 120] + [(900, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels, folds=7, held_out=9).collect()}
    counts = {i: T.Counter(T.words_of(t or "")) for i, t in rows}
    df = T.Counter(w for c in counts.values() for w in c)
    examples = [(i, int(i % 7 == 0) if i < 900 else 1, counts[i]) for i, _ in rows if i < 120 or i == 900]
    votes = brute_votes(examples, [counts[i] for i, _ in rows], len(rows), df)
    part = np.random.default_rng(5).permutation(len(examples)) % T.PARTS
    x, y = [0.0, 1.0], [0.0, 1.0]
    for p in range(T.PARTS):
        inside = [e for e, q in zip(examples, part, strict=True) if q == p]
        x += [v for v, _ in brute_votes([e for e, q in zip(examples, part, strict=True) if q != p], [c for _, _, c in inside], len(rows), df)]
        y += [label for _, label, _ in inside]
    order = sorted(range(2, len(x)), key=lambda i: (x[i], y[i])) + [0, 1]
    xs, fit = rising([x[i] for i in order], [y[i] for i in order])
    assert got[901].predicted == 1 and (got[901].evidence[0].doc_id, round(got[901].evidence[0].cosine, 9)) == (900, 1.0)
    for (i, _), (vote, near) in zip(rows, votes, strict=True):
        assert [(e.doc_id, round(e.cosine, 9), e.toxic) for e in got[i].evidence] == [(e, s, y) for s, e, y in near[:3]]
        below, above = fit[xs <= vote + 1e-9][-1], fit[xs >= vote - 1e-9][0]
        assert below - 1e-6 <= got[i].score <= above + 1e-6
