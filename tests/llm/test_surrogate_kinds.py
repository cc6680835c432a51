"""Surrogates of all kinds, planted between words: found wherever they stand, of the same type by independent checks, one for each entity."""

from __future__ import annotations

import ipaddress
import random
import re
import unicodedata

import pytest

from caselake.llm import surrogates

WORDS = "alpha river stone quietly under green table seven window later maple".split()


def luhn(text):
    d = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def mod97(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def iban(rng):
    country, bank, digits = rng.choice([("DE", "", 18), ("GB", "NWBK", 14), ("BE", "", 12), ("FR", "", 23)])
    body = bank + "".join(rng.choice("0123456789") for _ in range(digits))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{check:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def ipv6(rng):
    whole = ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8))
    return rng.choice([whole, f"2001:db8::{rng.randint(1, 65535):x}", f"fe80::{rng.randint(1, 65535):x}:{rng.randint(1, 65535):x}", f"FD00:{rng.randint(1, 9)}::A:1"])


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if luhn(head + c) % 10 == 0)


def ssn(rng):
    return f"{rng.randint(100, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"


NAMES = [("Mr. ", "山田"), ("Dr. ", "Παπαδόπουλος"), ("Prof. ", "김민준"), ("Ms. ", "תמרכהן"), ("г-жа ", "Соколова"), ("Mrs. ", "Johansson"), ("Mr. ", "สมชาย"), ("Dr. ", "タナカ"), ("Mr. ", "შევარდნაძე"), ("Mr. ", "कुमार")]
SECRETS = [('"password": "', "hunter22hunter22", '"'), ("'api_key' : '", "abc def", "'"), ('password="', "my secret phrase", '"'), ('"token":"', 'a\\"b c9', '"'), ("token=", "ПРИВЕТмир123", ""), ("secret: ", "Ab9Ab9", "")]


def planted(rng):
    """(before, entity, behind, kind)"""
    kind = rng.choice(["ipv6", "iban", "ssn", "card", "email", "name", "secret", "ip"])
    if kind == "name":
        return *rng.choice(NAMES), "", "name"
    if kind == "secret":
        before, value, behind = rng.choice(SECRETS)
        return before, value, behind, kind
    make = {"ipv6": ipv6, "iban": iban, "ssn": ssn, "card": card, "email": lambda r: f"p{r.randint(0, 99)}@site.org", "ip": lambda r: f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.7"}[kind]
    return "", make(rng), "", kind


@pytest.fixture(scope="module")
def replaced(spark):
    rng = random.Random(7)
    docs = []
    for _ in range(120):
        parts = [(" ".join(rng.choices(WORDS, k=rng.randint(1, 4))), *planted(rng)) for _ in range(rng.randint(1, 6))]
        docs.append(parts)
    texts = ["".join(f"{w} ({b}{e}{a}); " for w, b, e, a, _ in parts) for parts in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_personal(df, "k").collect()}
    out = []
    for k, parts in enumerate(docs):
        m = re.fullmatch("".join(re.escape(f"{w} ({b}") + "(.*?)" + re.escape(f"{a}); ") for w, b, _, a, _ in parts), got[k], re.S)
        assert m, (texts[k], got[k])
        out += [(kind, e, new) for (_, _, e, _, kind), new in zip(parts, m.groups(), strict=True)]
    return out


def script(text):
    return {unicodedata.name(c).split()[0] for c in text if c.isalpha()}


def test_each_is_replaced_by_its_type(replaced):
    assert {k for k, *_ in replaced} == {"ipv6", "iban", "ssn", "card", "email", "name", "secret", "ip"}
    for kind, old, new in replaced:
        assert new != old, (kind, old)
        if kind in ("ip", "ipv6"):
            a, b = ipaddress.ip_address(old), ipaddress.ip_address(new)
            assert a.version == b.version and (kind == "ip" or ("::" in old) == ("::" in new) and old.split(":")[0] == new.split(":")[0])
        elif kind == "iban":
            assert mod97(old) == mod97(new) == 1 and re.sub("[A-Z]", "A", re.sub(r"\d", "0", old)) == re.sub("[A-Z]", "A", re.sub(r"\d", "0", new)) and new[:2] == old[:2]
        elif kind == "ssn":
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new)
        elif kind == "card":
            assert luhn(new) % 10 == 0 and len(new) == len(old)
        elif kind == "email":
            assert re.fullmatch(r"[a-z]+\d+@[a-z]{4}\.org", new)
        elif kind == "secret":
            assert len(new) == len(old) and script(new) == script(old)
            assert all((o.isupper(), o.isdigit(), o.isalpha()) == (n.isupper(), n.isdigit(), n.isalpha()) for o, n in zip(old, new, strict=True))
            assert ('\\"' in old) == ('\\"' in new)
        else:
            assert script(new) == script(old), (old, new)


def test_one_entity_one_surrogate(replaced):
    same = {}
    for kind, old, new in replaced:
        key = re.sub(r"\s", "", old).lower() if kind in ("iban", "ipv6") else old
        assert re.sub(r"\s", "", same.setdefault((kind, key), new)) == re.sub(r"\s", "", new)
    assert len(set(same.values())) == len(same)


PLAIN = ["std::vector<int> abcd::efgh a::b", "at 12:34:56 and 1:2:3", "US20 THIS THAT", "phone 12-34-567", "the password is weak: yes", "token: abc", "Dr. who said", "a “secret”", "::", "fe80", "000-12-3456, 666-12-3456, 123-00-4567"]


def test_other_texts_stay(spark):
    df = spark.createDataFrame(list(enumerate(PLAIN)), "doc_id long, text string")
    assert [r["text"] for r in surrogates.replace_personal(df, "k").orderBy("doc_id").collect()] == PLAIN


def test_one_address_in_several_spellings(spark):
    rows = [(0, "2001:db8::1"), (1, "2001:0db8:0:0:0:0:0:1"), (2, "2001:DB8::0001"), (3, "fe80::"), (4, "1:2:3:4:5:6:7:0")]
    got = [r["text"] for r in surrogates.replace_personal(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert len({ipaddress.ip_address(t) for t in got[:3]}) == 1 and all(ipaddress.ip_address(t) != ipaddress.ip_address(o) for t, (_, o) in zip(got, rows, strict=True))


def test_a_hot_entity_and_long_secrets(spark):
    rows = [(k, "mail hot@site.org" if k % 2 else f"mail p{k}@site.org") for k in range(4_000)]
    rows += [(9_000, 'password="' + "x y" * 100_000 + '"'), (9_001, "password=" * 20_000), (9_002, '"token": "' + '\\"' * 5_000 + '"'), (9_003, "a:" * 50_000), (9_004, "DE12 " + "3456 " * 20_000)]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_personal(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert len(got) == len(rows) and len({got[k] for k in range(1, 4_000, 2)}) == 1 and len({got[k] for k in range(4_000)}) == 2_001
    assert "x y" not in got[9_000] and got[9_000].endswith('"')
