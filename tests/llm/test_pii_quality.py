import random
import re

import pytest

from cmdlens.llm import feistel_pii, suffix_quality
from cmdlens.llm.suffix_quality import Limits, assess_texts

from .cases import awkward, frame, simple, words


def pseudonyms(spark, texts, key="k"):
    rows = feistel_pii.pseudonymise(simple(spark, list(enumerate(texts))), key).collect()
    return [(r.text, [(p.kind, p.pseudonym) for p in r.pii]) for r in sorted(rows, key=lambda r: r.doc_id)]


def luhn_ok(number):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", number))):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_formats_validate_and_link(spark):
    texts = ["card 4111111111111111, 4111-1111-1111-1111 4111 1111 1111 1111!", "4111111111111111", "IBAN DE89370400440532013000.",
             "born 1990-02-28 and 31/12/1999, seen 12/25/2020", "ssn 123-45-6789", "10.0.0.1 and 203.0.113.77", "+1 (017) 555-7713 (212) 555-1234",
             "Foo.Bar+x@Mail.Example.com foo.bar+x@mail.example.com"]
    out = pseudonyms(spark, texts)
    cards = [p for k, p in out[0][1]]
    assert len(cards) == 3 and all(luhn_ok(c) for c in cards) and len({re.sub(r"\D", "", c) for c in cards}) == 1
    assert out[1][0] == cards[0] != "4111111111111111"
    iban = out[2][1][0][1]
    moved = iban[4:] + iban[:4]
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    import datetime as dt
    d = [p for _, p in out[3][1]]
    assert dt.date.fromisoformat(d[0]) and dt.datetime.strptime(d[1], "%d/%m/%Y") and dt.datetime.strptime(d[2], "%m/%d/%Y")
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[4][1][0][1])
    assert [len(x) for x in out[5][1][1][1].split(".")] == [3, 1, 3, 2] and all(int(x) < 256 for x in out[5][1][1][1].split("."))
    assert [k for k, _ in out[6][1]] == ["phone", "phone"] and out[6][1][0][1].startswith("+1 (")
    a, b = [p for _, p in out[7][1]]
    assert a.lower() == b and a != b and b.endswith(".com")
    for text, (new, _) in zip(texts, out):
        assert len(text) == len(new) and text != new
        assert re.sub(r"[0-9A-Za-z]", "x", text) == re.sub(r"[0-9A-Za-z]", "x", new)


def test_invalid_values_and_clean_text_stay(spark):
    texts = ["4111111111111112 000-12-3456 2020-13-45 999.1.1.1 1.2.3 v4.0. 12", "no data here", "DE00370400440532013000", "a@b", ""]
    out = pseudonyms(spark, texts)
    assert [t for t, _ in out] == texts and all(not p for _, p in out)


def test_permutation_is_injective_and_keyed(spark):
    r = random.Random(1)
    numbers = sorted({f"{r.randrange(10)}.{r.randrange(10)}.{r.randrange(10)}.{r.randrange(10)}" for _ in range(300)})
    days = [f"20{y:02d}-{m:02d}-{d:02d}" for y in range(3) for m in range(1, 13) for d in (1, 9, 28)]
    for values in (numbers, days):
        text = " ; ".join(values)
        a, b = (pseudonyms(spark, [text], k)[0][1] for k in ("k", "other"))
        assert len({p for _, p in a}) == len(values) and a != b


def test_pii_awkward_rows(spark):
    rows = awkward()
    out = feistel_pii.pseudonymise(frame(spark, rows), "k", found_col="found").collect()
    assert len(out) == len(rows)
    by = sorted((str(r[:10]) for r in rows if not r[1] or "@" not in r[1]))
    assert sorted(str(tuple(r)[:10]) for r in out if not r.text or "@" not in r.text) == by
    assert feistel_pii.pseudonymise(frame(spark, []), "k").count() == 0


def brute_quality(text, least):
    w = words(text)
    body = " " + " ".join(w) + " " if w else ""
    n = len(body)
    m = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and body[i + k] == body[j + k]:
                k += 1
            m[i] = max(m[i], k)
    covered = {x for i in range(n) if m[i] >= least for x in range(i, i + m[i])}
    at = {}
    for p in range(len(w) - 4):
        at.setdefault(tuple(w[p:p + 5]), []).append(p)
    repeat = {x for v in at.values() if len(v) > 1 for p in v for x in range(p, p + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    top = max(m, default=0)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat),
            round(len(covered) / n, 9) if n else 0, top if top >= least else 0)


def test_suffix_array_against_brute_force():
    r = random.Random(3)
    texts = [None, "", " \n", "a", "aaaa aaaa", "é é é é é é", "x y z w v " * 12]
    texts += ["".join(r.choice(["ab", "a", "b ", " ", "é\n", "c d", "\n", "\xa0", "#"]) * r.choice([1, 1, 4]) for _ in range(r.randint(0, 40)))
              for _ in range(120)]
    out = assess_texts(texts, Limits(min_repeat=8))
    for t, g in zip(texts, out.itertuples()):
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, round(g.covered_fraction, 9),
                g.longest_repeat) == brute_quality(t, 8), t


def test_very_long_text_and_blocks(monkeypatch):
    r = random.Random(4)
    long = " ".join(str(r.randrange(10**6)) for _ in range(200_000))
    texts = [long, "ab" * 300_000, "short text", long[:5000] * 2]
    whole = assess_texts(texts)
    assert list(whole.kept) == [True, False, False, False] and whole.longest_repeat[3] >= 4990
    monkeypatch.setattr(suffix_quality, "BLOCK_CHARS", 10)
    assert assess_texts(texts).equals(whole)


def test_quality_awkward_rows_keep_columns(spark):
    rows = awkward()
    df = frame(spark, rows)
    out = suffix_quality.assess(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    good = suffix_quality.keep_good(df)
    assert good.columns == df.columns and good.count() == sum(r.kept for r in out)
    assert suffix_quality.assess(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text,kept", [("the quick brown fox jumps over a lazy dog near this river bank today", True),
                                       ("buy now cheap deal " * 30, False)])
def test_verdicts(text, kept):
    assert bool(assess_texts([text]).kept[0]) is kept


def test_each_repetition_limit_decides_alone():
    r = random.Random(5)

    def fresh(n):
        return [f"{r.randrange(10**5):05d}" for _ in range(n)]
    phrases = [fresh(9) for _ in range(5)]  # 53 characters each
    spread = [w for p in phrases + phrases for w in p + fresh(37)]
    passage = fresh(25)
    one_long = fresh(400) + passage + fresh(800) + passage + fresh(400)
    out = assess_texts([" ".join(x) for x in (spread, one_long, fresh(400), fresh(400) + passage[:9] + fresh(40) + passage[:9])])
    limits = Limits()
    assert not out.base_failed.any() and list(out.kept) == [False, False, True, True]
    assert list(out.covered_fraction > limits.max_covered) == [True, False, False, False]
    assert list(out.longest_repeat > limits.max_longest) == [False, True, False, False]


def test_values_next_to_and_inside_failed_candidates(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = [("in 2024 " + card, "in 2024 ", card, "card", ""), ("exp 1225 " + card, "exp 1225 ", card, "card", ""),
             (iban + " EUR", "", iban, "iban", " EUR"), (iban + " 1332 100 EUR", "", iban, "iban", " 1332 100 EUR"),
             ("ES91 2100 0418 4502 0005 1332 100 EUR", "", "ES91 2100 0418 4502 0005 1332", "iban", " 100 EUR"),
             ("+44 20 7946 0958 2021 12", "", "+44 20 7946 0958", "phone", " 2021 12"),
             ("at 2024-02-29T10:00:00Z", "at ", "2024-02-29", "date", "T10:00:00Z")]
    alone = pseudonyms(spark, [c[2] for c in cases])
    for (text, before, value, kind, after), (new, found), (single, _) in zip(cases, pseudonyms(spark, [c[0] for c in cases]), alone):
        assert found == [(kind, single)] and single != value and new == before + single + after, text


def test_many_values_of_one_text(spark):
    r = random.Random(8)
    values = ["2024 4111 1111 1111 1111", "4111111111111112", "2024-02-29", "é 1234 5678", "me@example.com", "10.0.0.1"]
    picks = [r.choice(values) for _ in range(700)]
    single = dict(zip(values, pseudonyms(spark, values)))
    new, found = pseudonyms(spark, [", ".join(picks)])[0]
    assert new == ", ".join(single[v][0] for v in picks) and found == [p for v in picks for p in single[v][1]]
