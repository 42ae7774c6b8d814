import hashlib
import random
import re
import time

import pytest

from quadrille.llm import pii


def plain(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(found)]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    for alphabet in ("a@.b- ", "0123.", "01 -+().4", "a1@.+é 2", "0 1-2345678", "4@1.a"):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert pii.base_spans(t) == plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to anna [at] example [dot] com now", "email", "anna [at] example [dot] com"),
        ("write to anna(at)example(dot)com now", "email", "anna(at)example(dot)com"),
        ("write to anna at example dot com now", "email", "anna at example dot com"),
        ("é write to аnnа@exаmple.com now", "email", "аnnа@exаmple.com"),
        ("mail anna​@exam​ple.com now", "email", "anna​@exam​ple.com"),
        ("server １０.0.0.２５ is up", "ip", "１０.0.0.２５"),
        ("server 10 dot 0 dot 0 dot 25 is up", "ip", "10 dot 0 dot 0 dot 25"),
        ("call plus one four one five five five five two six seven one please", "phone", "plus one four one five five five five two six seven one"),
        ("card four one one one 1111 1111 one one one one thanks", "card", "four one one one 1111 1111 one one one one"),
        ("write to john dot doe at mail dot example dot org now", "email", "john dot doe at mail dot example dot org"),
        ("write to john_at_example_dot_com now", "email", "john_at_example_dot_com"),
        ("write to john&#64;example&period;com now", "email", "john&#64;example&period;com"),
        ("write to john @ example.com now", "email", "john @ example.com"),
        ("host one nine two dot 168 dot zero dot one five up", "ip", "one nine two dot 168 dot zero dot one five"),
        ("call plus one (four one five) five five five - two six seven one.", "phone", "plus one (four one five) five five five - two six seven one"),
        ("call +1 (415) five five five 26 seven one or", "phone", "+1 (415) five five five 26 seven one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    base, found = pii.all_spans(text)
    assert base == plain(text)
    assert (text.index(part), text.index(part) + len(part), kind) in found


def test_spans_of_one_start_are_in_the_order_of_kinds():
    for text, want in (("4111111111111111@x.com", "email:0:22,card:0:16"), ("1.2.3.4@x.com", "email:0:13,ip:0:7")):
        base, found = pii.all_spans(text)
        assert pii.written(base) == pii.written(found) == pii.written(plain(text)) == want


@pytest.mark.parametrize(
    "unit",
    ["a-dot-", "x@a-dot-", "a dot ", "a_at_", "a at b dot ", "a [at] ", "one two ", "one dot ", "&#64;", "a@", "1 dot ", "@ ", "-dot", "dot_dot_", "plus one two ", "a--", "1.", "+1 (", "x @ y.", "​", "о@"],
)
@pytest.mark.parametrize("before", ["", "x@", "x at ", "éone "])
def test_long_repeats_end_soon(unit, before):
    began = time.perf_counter()
    pii.all_spans(before + unit * 50_000)
    assert time.perf_counter() - began < 2, unit


def test_labels_and_locals_of_any_number():
    whole = "a" + " dot b" * 30 + " at c" + " dot d" * 30
    assert pii.all_spans(f"to {whole}, so")[1] == [(3, 3 + len(whole), "email")]
    text = "a at b dot c at d dot e"
    assert [text[s:e] for s, e, _ in pii.all_spans(text)[1]] == ["a at b dot c"]


COUNTS = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    c AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards FROM d)
    SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255)) AS n_ip,
        len(list_filter(cards, lambda x: len(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(len(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[len(x) - i]::INT ELSE x[len(x) - i]::INT * 2 - CASE WHEN x[len(x) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
        len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS n_phone
    FROM c"""


def test_counts_of_the_whole_table_are_those_of_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = pii.find_personal_data(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect()
    want = con.execute(COUNTS).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(map(sum, (x[1:] for x in want))) > 0


def test_clean_prose_gains_nothing():
    for text in ("We met at the station at nine, one two three steps away (at noon).", "Look at example dot", "été à la fin – voilà", "one at a time, two at most", "at two, dot one, at three at dot", "a-at-b _dot_ c", "one two dot three", "He said: dot the i. At last [at least] one."):
        assert pii.all_spans(text) == ([], [])


def test_rows_of_every_kind(make_docs, messy):
    card = "4111 1111 1111 1111"
    rows = [*messy, (70, f"é😀 a@b.co, {card}; 1.2.3.4 +1 (415) 555-2671"), (70, f"é😀 a@b.co, {card}; 1.2.3.4 +1 (415) 555-2671"), (None, "a@b.co"), (71, "9" * 200000), (72, "a" * 200000 + "@"), (73, "+1" * 50000), (74, "dot " + "one " * 30000), (75, "x" * 50000 + " dot one two " + "a_" * 30000), (76, "one,(" * 20000)]
    out = pii.find_personal_data(make_docs(rows)).collect()
    assert len(out) == len(rows)
    for i in (70,):
        got = [r for r in out if r.doc_id == i]
        expected = pii.written(plain(dict(rows)[i]))
        assert [r.spans for r in got] == [expected] * 2
        assert got[0].base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    masked = {r.doc_id: r for r in pii.mask_personal_data(make_docs(rows)).collect()}
    assert masked[70].text == "é😀 [EMAIL], [CARD]; [IP] [PHONE]" and masked[70].n_chars == len(masked[70].text)
    assert masked[0].text is None and masked[0].n_chars is None and masked[6].text == dict(rows)[6]
    assert pii.find_personal_data(make_docs([])).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "part", "masked"),
    [
        ("to jоhn.smith@example.com now", "email", "jоhn.smith@example.com", "to [EMAIL] now"),
        ("to john [dot] smith@example.com now", "email", "john [dot] smith@example.com", "to [EMAIL] now"),
        ("to anna@mail.example [dot] com now", "email", "anna@mail.example [dot] com", "to [EMAIL] now"),
        ("to anna@mail.exаmple.com now", "email", "anna@mail.exаmple.com", "to [EMAIL] now"),
        ("call +1 415 555 267１ now", "phone", "+1 415 555 267１", "call [PHONE] now"),
        ("pay 4111 1111 1111 1111, a@b.co, 1.2.3.４ now", "ip", "1.2.3.４", "pay [CARD], [EMAIL], [IP] now"),
    ],
)
def test_a_wider_disguised_span_stands_beside_the_base_span(text, kind, part, masked):
    base, found = pii.all_spans(text)
    assert base == plain(text) and set(base) <= set(found)
    assert (text.index(part), text.index(part) + len(part), kind) in found
    assert pii.mask(text) == masked


def test_spans_within_a_base_span_of_their_kind_add_nothing():
    text = "é pay 4111 1111 1111 1111 １２３, аnna@b.co"
    base, found = pii.all_spans(text)
    assert [text[s:e] for s, e, _ in base] == ["4111 1111 1111 1111", "nna@b.co"]
    assert sorted(set(found) - set(base)) == [(text.index("аnna"), len(text), "email")]
