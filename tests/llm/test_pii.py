import random
import re

from lorekeep.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.BASE for m in re.finditer(RULES[k], text) if valid(k, m[0])]


def test_base_equals_the_patterns():
    random.seed(2)
    pools = ["0123456789 -.+@a", "a@.-b_%é", "01.2.255 300.", "+12(3) .-\n", "12345678901234567890 -"]
    texts = ["".join(random.choice(p) for _ in range(random.choice([0, 5, 20, 60, 200]))) for p in pools for _ in range(1500)]
    texts += ["4785380592391139", "x4785380592391139 4785380592391139", " 1.2.3.4.5.6.7.8 00255.1.1.0001", "a@b.c@d.e"]
    found = pii.spans_of([t.encode() for t in texts], pii._automaton())
    for t, f in zip(texts, found):
        assert [(pii.KINDS[k], s, e) for k, s, e in f if k < 4] == brute(t), t


def test_spans_that_the_method_adds():
    text = 'é IBAN: GB82 WEST 1234 5698 7654 32, account no. 12345678; token = "24be64439e3e49cf46b2" https://bob:pw@host/x wanted 5'
    (found,) = pii.spans_of([text.encode()], pii._automaton())
    assert {(pii.KINDS[k], text[s:e]) for k, s, e in found} == {("account", "GB82 WEST 1234 5698 7654 32"), ("account", "12345678"), ("secret", "24be64439e3e49cf46b2"), ("login", "bob:pw")}


def test_logins_of_any_letters_and_time_in_proportion():
    import time

    for text, want in (("https://bobà:pw@host", "bobà:pw"), ("ftp://b\u0085x:p\u00a0w@h", "b\u0085x:p\u00a0w"), ("https://a b:c@host https://:c@host https://a:b@@", "")):
        (found,) = pii.spans_of([text.encode()], pii._automaton())
        assert ",".join(text[s:e] for k, s, e in found if pii.KINDS[k] == "login") == want
    (found,) = pii.spans_of([b"token=aaaaaaaaaaaaaaaaaaaa-token= abcdefgh12345678 secret:x-token=abcdefgh12345678"], pii._automaton())
    assert [(s, e) for _, s, e in found] == [(34, 50), (58, 82)]
    start = time.perf_counter()
    for part in ("token=", "a@", "://a:", "+1", "1.", "12 ", "iban de", "account 1-", "de1"):
        pii.spans_of([(part * (600_000 // len(part))).encode()], pii._automaton())
    assert time.perf_counter() - start < 60


def test_query_on_documents(spark, small):
    from lorekeep.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_pii_anchor_expansion(spark, small).collect():
        import hashlib

        own = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b for k, _, _ in own) for b in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()


def test_odd_rows(odd, empty):
    got = {r.doc_id: r.spans for r in pii.find(odd).collect()}
    assert [(s.kind, s.start, s.end) for s in got[7]] == [("email", 17, 31), ("phone", 32, 49)] and got[2] == got[6] == []
    clean = pii.redact(odd, n_chars="n_chars")
    assert clean.columns == odd.columns and clean.count() == odd.count()
    (r,) = clean.where("doc_id = 7").collect()
    assert r.text == "数据库 émile 😀 mail <EMAIL> <PHONE>" and r.n_chars == len(r.text)
    assert clean.where("doc_id = 2 and text is null and n_chars is null").count() == 1
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_ibans_end_at_their_countrys_length():
    for text, want in (
        ("IBAN: DE89 3704 0044 0532 0130 00 by Friday, thanks", "DE89 3704 0044 0532 0130 00"),
        ("IBAN: DE89370400440532013000 is mine.", "DE89370400440532013000"),
        ("pay to NO93 8601 1117 947 or é GB82WEST12345698765432 12", "NO93 8601 1117 947,GB82WEST12345698765432"),
        ("iban GB82WEST12345698765432 account GB82WEST12345698765432 and more", "GB82WEST12345698765432,GB82WEST12345698765432"),
        ("IBAN: DE88 3704 0044 0532 0130 00 by Friday; xDE89370400440532013000 DE893704004405320130001", ""),
        ("account: ZZ71370400440532013 it is", "ZZ71370400440532013"),
    ):
        (found,) = pii.spans_of([text.encode()], pii._automaton())
        assert ",".join(text[s:e] for k, s, e in found if pii.KINDS[k] == "account") == want, text
