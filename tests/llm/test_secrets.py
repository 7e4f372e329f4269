import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from pageloom.llm import secrets
from tests.llm.odd import COLUMNS, no_documents, odd_documents


def plain_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, e, k) for s, k, e in sorted(out)]


CASES = [
    "password=token=abcdefgh1 secret: token : abcdefgh123", 'API_KEY="' + "A1b2" * 5 + '" apikey = short', "ſecret=abcdefghij toKen=abcdefghij",
    "AKIA" + "B" * 12 + " AKIA" + "B" * 11 + " xAKIAAKIA" + "C" * 9, "f" * 31 + " " + "0" * 32 + "g" + "a1" * 40, "été \U0001f600 password:12345678",
    "passwd'  :  'abc/def+ghi=", "secret=" + "0123456789abcdef" * 3, "",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_base(text)


def test_base_spans_of_random_texts():
    dice = random.Random(6)
    parts = ["password", "SECRET", "token", "api_key", "apiKey", "=", ":", " ", '"', "'", "AKIA", "abcdef01", "0", "f", "Z9", "é", "\n", "\t", ".", "/", "a" * 40, "AKIAABCDEFGHIJKL"]
    for _ in range(2000):
        text = "".join(dice.choices(parts, k=dice.randint(1, 25)))
        got = [s for s in next(secrets.scan(pa.array([text]), secrets.ALLOW))[1] if s[2] < 3]
        assert got == plain_base(text), text


def test_window_entropies_are_those_of_fresh_counts():
    dice = random.Random(1)
    text = "".join(dice.choices("abcdef0123456789", k=200))
    for k, bits in enumerate(secrets.window_entropies(text, 20)):
        counts = Counter(text[k:k + 20])
        assert bits == pytest.approx(-sum(n / 20 * math.log2(n / 20) for n in counts.values()))


def test_entropy_finds_keys_and_the_allow_list_silences():
    dice = random.Random(3)
    key = "".join(dice.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    text = f"the value é {key} was leaked, see 123e4567-e89b-12d3-a456-426614174000 and sha256:{'9f86d081884c7d659a2feaa0c55ad015'.upper()}"
    (_, found), = secrets.scan(pa.array([text]), secrets.ALLOW)
    assert found == [(12, 52, 3)]
    (_, silenced), = secrets.scan(pa.array([text]), (*secrets.ALLOW, re.escape(key)))
    assert silenced == []
    prose = "internationalisationofverylongwordswithoutanyblanks path/to/some/file_name-2024 " * 5
    assert next(secrets.scan(pa.array([prose]), secrets.ALLOW))[1] == []
    base = f"token={key}"
    assert [s[2] for s in next(secrets.scan(pa.array([base]), (*secrets.ALLOW, ".*")))[1]] == [0]


def test_rows_that_lie_side_by_side():
    key = "deadbeef01234567deadbeef01234567"
    column = pa.array(["x", None, key, "", key[:20], key[20:], "password=abcdefgh"]).slice(1)
    assert [[x[2] for x in s] for _, s in secrets.scan(column, secrets.ALLOW)] == [[], [2], [], [3] if secrets.spans(key[:20], lambda s: False) else [], [], [0]]


def test_query_rows(spark):
    got = secrets.found_secrets(spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "doc_id long, text string")).collect()
    for r in got:
        want = plain_base(CASES[r.doc_id])
        names = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[2] == k for w in want) for k in range(3)]
        assert set(filter(None, names.split(","))) <= set(r.spans.split(","))


def test_masks_and_odd_rows(spark):
    more = [(20, "é password=abcdefgh12 end", "en", "a", 0)]
    docs = odd_documents(spark, more)
    got = secrets.without_secrets(docs)
    assert got.columns == docs.columns and got.count() == 12
    row = got.where("doc_id = 20").first()
    assert row.text == "é <hidden> end" and row.n_chars == len(row.text)
    untouched = {r.doc_id: r for r in docs.where("doc_id <> 20").collect()}
    assert {r.doc_id: r for r in got.where("doc_id <> 20").collect()} == untouched
    assert secrets.masked("abcdef", [(1, 4, 0), (2, 5, 2)], "#") == "a#f"
    assert secrets.found_secrets(docs).count() == 12
    assert secrets.found_secrets(no_documents(spark)).count() == 0 == secrets.without_secrets(no_documents(spark)).count()
    assert secrets.without_secrets(spark.createDataFrame([(1, "token: abcdefgh")], "doc_id long, text string")).first().text == "<hidden>"
    assert COLUMNS
