from __future__ import annotations

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        out += [("card", *m.span())] * (13 <= len(d) <= 19 and luhn(d))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


FIXED = [
    "", None, "a@b.c", "x a.b+c@d-e.fg.h_i@j.k", "a@b.cd_e@x.y", "a@@b.c d@e", "1.2.3.4", "999.1.1.1.1", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111",
    "4111111111111112", "1 " * 25, "+1 (826) 555-2748", "+1 2", "++12345678901", "+123456789 +1234567890123456", "é́𝕏 mail: 𝕏a@b.co +44 20 7946 0958", "+4111 1111 1111 1111", "token = \"bc0d31ba76f17e56632e8751295a3fd50cd8aa11\"",
    "12345678901234567890123", "a" * 50_000 + "@b.c " + "7" * 40_000 + " " + "1.2.3.4 " * 300, "1.1.1.1@2.2.2.2.c",
]


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in pii.spans(pii.prepared(df), pii.estimate([])).collect():
        want = plain(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in want) for k in pii.BASE]
        assert r.spans == joined or r.spans.startswith(joined + "," if joined else ""), texts[r.doc_id]


def test_base_spans_equal_the_plain_patterns(spark):
    check(spark, FIXED)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab1 2349.@+-()_%é\n", max_size=60), min_size=40, max_size=60))
def test_base_spans_on_random_texts(spark, texts):
    check(spark, texts)


def corpus(spark):
    rows = [(i, f"lorem ipsum token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" dolor") for i in range(60)]
    rows += [(100 + i, f"see commit {hashlib.sha1(str(-i).encode()).hexdigest()} in the log") for i in range(40)]
    rows += [(200 + i, f"order 12{i:02d}-0000000-00 page {i} was aaaaaaaaaaaaaaaaaaaa1") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_added_spans_follow_the_votes(spark):
    df = corpus(spark)
    ready = pii.prepared(df)
    model = pii.fit(ready)
    kinds = {r.doc_id: r.spans for r in pii.spans(ready, model).collect()}
    assert all(kinds[i].startswith("secret:") for i in range(60))
    assert all("secret" not in kinds[i] for i in range(100, 230) if i in kinds)
    # reliability: an assignment sign speaks for private data, and words against it do so
    assert model.reliabilities["secret"]["assigned"][1][0] > model.reliabilities["secret"]["assigned"][1][1]
    # standing alone after an ordinary word, the same token is none
    alone = spark.createDataFrame([(1, f"the build {hashlib.sha1(b'9').hexdigest()} was fine"), (2, f"it was {hashlib.sha1(b'8').hexdigest()} then")], "doc_id int, text string")
    assert [r.spans for r in pii.spans(pii.prepared(alone), model).collect()] == ["", ""]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or +1 (826) 555-2748!", 7, "x"), (2, None, 0, "y"), (3, "clean", 5, None)], "doc_id int, text string, n_chars int, spans string")
    rows = {r.doc_id: r for r in pii.redacted(pii.prepared(df), pii.estimate([])).collect()}
    assert rows[1].text == "mail <EMAIL> or <PHONE>!" and rows[2].text is None and rows[3].text == "clean"
    assert pii.redacted(pii.prepared(df), pii.estimate([])).columns == df.columns


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id int, text string, spans string")
    model = pii.fit(pii.prepared(df))
    assert pii.spans(pii.prepared(df), model).count() == 0
    plan = pii.spans(pii.prepared(df), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_of_any_length_are_candidates(spark):
    unit = hashlib.sha256(b"x").hexdigest()
    tokens = ["Ab3" + unit, "Ab" + unit * 4, "k" * 60 + "7" + unit, unit * 3000 + "==", "z" * 60_000 + "1"]
    texts = [f"api_key = \"{t}\" end" for t in tokens] + ["x" * 300, "word " * 100 + "/" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in pii.spans(pii.prepared(df), pii.fit(pii.prepared(corpus(spark)))).collect()}
    assert [spans[i] for i in range(4)] == [f"secret:11:{11 + len(t)}" for t in tokens[:4]]
    assert spans[5] == spans[6] == ""
    seen = df.selectExpr("doc_id", f"size(filter({pii._candidates('text')}, x -> x.k = 'secret')) as n")
    assert [r.n for r in seen.orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0, 0]


def test_very_many_matches(spark):
    """Positions beyond one block of matches."""
    text = "é a@b.co " * 3000 + "1.2.3.4"
    r = pii.spans(pii.prepared(spark.createDataFrame([(1, text)], "doc_id int, text string")), pii.estimate([])).first()
    assert (r.n_email, r.n_ip) == (3000, 1) and r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))


def test_reliabilities_come_from_agreement():
    """Labelers whose votes go together become reliable; one that votes at random learns that it isn't."""
    votes = {}
    for private in (0, 1):
        for noise in (0, 1):
            pattern = tuple({"form": private, "cue": private, "assigned": private, "gazetteer": noise}.get(n, 0) for n in pii.LABELERS)
            votes[pattern] = 400.0
    table, chance = pii.reliabilities_of(votes)
    odds = {n: table[n][1][0] / table[n][1][1] for n in pii.LABELERS}
    assert odds["form"] > 5 and odds["cue"] > 5 and 0.5 < odds["gazetteer"] < 2
    assert all((p > 0.9) == (v[0] == 1) and (p < 0.1) == (v[0] == 0) for v, p in chance.items())


def test_other_kinds_are_found_by_context(spark):
    rows = [(i, f"please call phone: 212-55{i % 10}-01{i % 10}9 now") for i in range(40)] + [(100 + i, f"Dear Anna Mustermann{'abcdefgh'[i % 8]}, hello") for i in range(40)]
    rows += [(200 + i, "The The For For Over Under and 017-555-7713 in the list") for i in range(40)]
    ready = pii.prepared(spark.createDataFrame(rows, "doc_id int, text string"))
    kinds = {r.doc_id: r.spans for r in pii.spans(ready, pii.fit(ready)).collect()}
    assert all("local_phone" in kinds[i] for i in range(40)), kinds[0]
    assert all("name" in kinds[100 + i] for i in range(40)), kinds[100]
    assert not any(kinds[200 + i] for i in range(40))
