"""Pseudonyms against a plain version that shares no code with the operator."""

import datetime
import hashlib
import hmac
import ipaddress
import random
import re

import pytest

from docketlake.llm import pii

SECRET = "a secret of this test"
RAW = hashlib.sha256(b"pseudonyms|" + SECRET.encode()).digest()


def keyed(kind, r, value):
    return hmac.new(RAW, f"{kind}|{r}|{value}".encode(), hashlib.sha256).hexdigest()


def numbers(kind, a, b, bound_a, bound_b):
    for r in range(10):
        if r % 2 == 0:
            a = (a + int(keyed(kind, r, b)[:13], 16)) % bound_a
        else:
            b = (b + int(keyed(kind, r, a)[:13], 16)) % bound_b
    return a, b


def digit_string(kind, digits):
    n, u = len(digits), len(digits) // 2
    a, b = numbers(f"{kind}:{n}", int(digits[:u] or 0), int(digits[u:]), 10**u, 10 ** (n - u))
    return f"{a:0{u}d}"[: u or None] * bool(u) + f"{b:0{n - u}d}"


def put(template, digits):
    left = list(digits)
    return "".join(left.pop(0) if c.isdigit() else c for c in template)


def luhn(payload):
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def card(x):
    d = re.sub(r"\D", "", x)
    if luhn(d[:-1]) != d[-1]:
        return x
    new = digit_string("card", d[:-1])
    return put(x, new + luhn(new))


def social(x):
    area, group, serial = map(int, x.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return x
    a, b = numbers("social", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    i = a // 99
    return f"{i + 1 + (i >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def address(x):
    p = list(map(int, x.split(".")))
    if max(p) > 255:
        return x
    a, b = numbers("address", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def address6(x):
    try:
        whole = int(ipaddress.IPv6Address(x))
    except ValueError:
        return x
    a, b = whole >> 64, whole & (2**64 - 1)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    for r in range(10):
        if r % 2 == 0:
            a ^= int(keyed("address6", r, signed(b))[:16], 16)
        else:
            b ^= int(keyed("address6", r, signed(a))[:16], 16)
    return ipaddress.IPv6Address(a << 64 | b).exploded


def date(x, form):
    try:
        day = datetime.datetime.strptime(x, form).date()
    except ValueError:
        return x
    if not 1904 <= day.year <= 2099:
        return x
    n = (day - datetime.date(1904, 1, 1)).days
    a, b = numbers("date", n // 1461, n % 1461, 49, 1461)
    return (datetime.date(1904, 1, 1) + datetime.timedelta(a * 1461 + b)).strftime(form)


def phone(x, kept, code):
    rest = x[len(kept) :]
    return kept + put(rest, digit_string(f"phone:{code}", re.sub(r"\D", "", rest)))


def letters(kind, a, b):
    def moved(text, digest):
        out = []
        for i, c in enumerate(text):
            by = int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)
            for first, n in (("a", 26), ("A", 26), ("0", 10)):
                if 0 <= ord(c) - ord(first) < n:
                    c = chr((ord(c) - ord(first) + by) % n + ord(first))
                    break
            out.append(c)
        return "".join(out)

    for r in range(10):
        if r % 2 == 0:
            a = moved(a, keyed(kind, r, b))
        else:
            b = moved(b, keyed(kind, r, a))
    return a + b


def mail(x):
    local, domain = x.split("@")
    return letters("mail", local[: len(local) // 2], local[len(local) // 2 :]) + "@" + domain


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(x):
    plain = x.replace(" ", "")
    if mod97(plain[4:] + plain[:4]) != 1:
        return x
    bank = plain[4:]
    new = letters(f"iban:{plain[:2]}", bank[: len(bank) // 2], bank[len(bank) // 2 :])
    left = list(f"{plain[:2]}{98 - mod97(new + plain[:2] + '00'):02d}{new}")
    return "".join(c if c == " " else left.pop(0) for c in x)


def cases():
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(12):
        p = rng.choice("345") + digits(14)
        x = p + luhn(p)
        yield x, card(x)
        x = " ".join(x[i : i + 4] for i in range(0, 16, 4))
        yield x, card(x)
        x = f"{digits(3)}-{digits(2)}-{digits(4)}"
        yield x, social(x)
        x = ".".join(str(rng.randint(0, 280)) for _ in range(4))
        yield x, address(x)
        d = datetime.date(1890, 1, 1) + datetime.timedelta(rng.randint(0, 80000))
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"):
            yield d.strftime(form), date(d.strftime(form), form)
        x = f"+1 {rng.randint(2, 9)}{digits(2)} {digits(3)} {digits(4)}"
        yield x, phone(x, "+1", "1")
        x = f"+44 (0){rng.randint(2, 9)}{digits(1)} {digits(4)} {digits(4)}"
        yield x, phone(x, "+44 (0)", "44")
        x = f"+353-{rng.randint(2, 9)}{digits(1)}-{digits(3)}-{digits(4)}"
        yield x, phone(x, "+353", "353")
        x = f"u{digits(3)}.Name{rng.randint(1, 99)}@mail.example.org"
        yield x, mail(x)
        x = f"2001:db8:{rng.randint(1, 9999)}::{rng.randint(1, 9999):x}"
        yield x, address6(x)
        bank = f"ABCD{digits(14)}"
        x = f"GB{98 - mod97(bank + 'GB00'):02d}{bank}"
        yield x, iban(x)
        x = " ".join(x[i : i + 4] for i in range(0, len(x), 4))
        yield x, iban(x)
    yield "2001:db8:0:0:0:0:0:1", address6("2001:db8::1")
    yield "GB00ABCD00000000000000", "GB00ABCD00000000000000"


def test_equal_to_the_plain_version(spark):
    rows = list(cases())
    df = spark.createDataFrame([(i, f"before {x}, and {x} after") for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymised(df, SECRET).collect()}
    for i, (x, new) in enumerate(rows):
        assert got[i][0] == f"before {new}, and {new} after", x
        assert got[i][1] == 2 * (new != x)
    assert sum(new != x for x, new in rows) > 0.8 * len(rows)


def test_all_spellings_of_a_telephone_number_stay_linked(spark):
    spellings = ["+15551234567", "+1 555 123 4567", "+1-555-123-4567", "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "1-555-123-4567", "1 (555) 123-4567"]
    df = spark.createDataFrame([(i, f"call {x} now") for i, x in enumerate(spellings)], "doc_id long, text string")
    got = [re.sub(r"\D", "", r.text)[-10:] for r in pii.pseudonymised(df, SECRET).collect()]
    assert len(set(got)) == 1 and got[0] != "5551234567"
    british = spark.createDataFrame([("+44 20 7946 0958",), ("+442079460958",), ("+44 (0)20 7946 0958",)], "text string")
    assert len({re.sub(r"\D", "", r.text)[-10:] for r in pii.pseudonymised(british, SECRET).collect()}) == 1


def test_the_key_is_not_in_the_plan(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org")], "doc_id long, text string")
    plan = pii.pseudonymised(df, SECRET)._jdf.queryExecution().toString()
    for word in (SECRET, RAW.hex(), RAW.hex().upper()):
        assert word not in plan
    assert bytes(x ^ 0x36 for x in RAW).hex().upper() not in plan.upper()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        pii.pseudonymised(df, "")


def test_names_with_dots_clashes_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a.b@c.org " * 20_000, "x", "y", 5), (2, None, "x", "y", 5), (3, "", "x", "y", 5)], "`doc.id` long, `te.xt` string, marks string, key string, n_pii int")
    got = {r["doc.id"]: (r.n_pii, r.marks, r.key) for r in pii.pseudonymised(df, SECRET, text="te.xt").collect()}
    assert got == {1: (20_000, "x", "y"), 2: (0, "x", "y"), 3: (0, "x", "y")}
