import hashlib
import random
import re

from vqloom.llm import pii

from .rows import documents, empty

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x) % 10 + (2 * x) // 10 for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in found]


def check(docs):
    want = sorted((str(r["doc_id"]), hashlib.sha256(",".join(base(r["text"])).encode()).hexdigest(), *(sum(x.startswith(k) for x in base(r["text"])) for k in KINDS)) for r in docs.collect())
    rows = pii.op4_pii(docs).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows) == want
    return rows


def test_random_texts_match_brute_force(spark):
    r = random.Random(8)
    bits = ["a", "b@", "@", ".", "1", "25", "255", "256", "0", " ", "-", "+", "+1 ", "(", ")", "é", "😀", "4111111111111111", "4111-1111-1111-1111", "x@y.zz", "1.2.3.4", "_", "\n", "00000300.1.1.1", "379354508162306"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(400)]
    check(spark.createDataFrame(docs, "doc_id long, text string"))


def test_odd_rows(spark):
    rows = check(documents(spark))
    assert any("iban:" in r["spans"] for r in rows)
    assert pii.op4_pii(empty(spark)).count() == 0


def test_long_runs_stay_linear(spark):
    cells = ["1 " * 200_000, "a" * 300_000, "1" * 200_000, "1." * 99_998, "a@" * 100_000, "+1" * 100_000]
    rows = {r["doc_id"]: r for r in pii.op4_pii(spark.createDataFrame(list(enumerate(cells)), "doc_id long, text string")).collect()}
    assert rows[3]["n_ip"] == 24_999 and sum(r["n_email"] + r["n_card"] + r["n_phone"] for r in rows.values()) == 0


def test_context_and_checksums(spark):
    texts = [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 32"), (3, "iban GB82 WEST 1234 5698 7654 33"), (4, "my account 123456789012"), (5, "nothing 123456789012")]
    spans = {r["doc_id"]: r["spans"] for r in pii.op4_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert spans[1].startswith("iban:5:") and spans[2].startswith("iban:0:") and "iban" not in spans[3]
    assert spans[4] == "id:11:23" and spans[5] == ""


def spans_of(spark, texts):
    rows = pii.op4_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["spans"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_short_numbers_need_no_other_number(spark):
    texts = ["ssn 123-45-6789", "passport 123456789", "tax 1234567890", "ssn 12345678", "see 123456789", "ssn 123-45-6789 and then, far away from any such word, 999999999999"]
    assert spans_of(spark, texts) == ["id:4:15", "id:9:18", "id:4:14", "", "", "id:4:15"]


def test_what_follows_an_iban_takes_nothing_from_it(spark):
    one, parts = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [f"iban {one} Please", f"IBAN {parts} BIC COBADEFFXXX", f"IBAN {parts} 12", f"{parts} GB82 WEST 1234 5698 7654 32", f"AB12 CDEFGHIJKLM {one}", f"IBAN {one}0 x", f"IBAN {one}a", f"{parts}, ok"]
    assert spans_of(spark, texts) == ["iban:5:27", "iban:5:32", "iban:5:32", "iban:0:27,iban:28:55", "iban:17:39", "", "", "iban:0:27"]


def test_many_iban_heads_stay_linear(spark):
    heads, real = "AB12 " * 60_000, "DE89370400440532013000 "
    spans = spans_of(spark, [heads, heads + "A" * 100_000, real * 2_000])
    assert spans[:2] == ["", ""] and spans[2].count("iban:") == 2_000


def test_every_octet_in_every_place(spark):
    octets = ["0", "00", "000", "1", "01", "010", "255", "0255", "256", "0256", "300", "1000"]
    texts = []
    for place in range(4):
        for o in octets:
            parts = ["8", "0", "4", "10"]
            parts[place] = o
            texts.append(f"ip {'.'.join(parts)} x")
    texts += ["10.0.0.1 and 192.168.0.1 and 8.8.4.4 and 010.1.1.1", "0.0.0.0", "0.0.0", "00000.0.0.0000"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
