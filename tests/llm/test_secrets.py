import hashlib
import math
import random
import re
import string

from cmdlens.llm import queries, secret_scan

from .cases import awkward, frame, simple

SF_DIR = "/root/testdata/sf0.01"   # the smallest table holds no secret

WORD = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(" + WORD + ")", re.I | re.A)
ALPHABETS = [("0123456789abcdef", True), ("abcdefghijklmnopqrstuvwxyz234567", True), (string.digits + string.ascii_lowercase, True),
             (string.digits + string.ascii_uppercase + string.ascii_lowercase, False),
             (string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", False),
             (string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_", False)]
SIGNS = ["[0-9A-F]+|[0-9a-f]+", "[A-Z2-7]+", "[0-9A-Z]+|[0-9a-z]+", "[0-9A-Za-z]+", "[0-9A-Za-z+/]+", "[0-9A-Za-z_-]+"]
NULL = list(secret_scan.NULL.values())


def base_of(text):
    """The contract: leftmost matches of the plain patterns, failing ones dropped afterwards."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def p_value(token):
    """The battery in plain Python; None for a token of no encoding."""
    if not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return None
    at = next((i for i, s in enumerate(SIGNS) if re.fullmatch(s, token)), None)
    if at is None:
        return None
    (alphabet, one_case), (pair, triple, change, near) = ALPHABETS[at], NULL[at]
    folded = token.lower() if one_case else token
    n = len(token)
    squares = sum(folded.count(c) ** 2 for c in alphabet)
    chi = len(alphabet) / n * squares - n
    null_mean = len(alphabet) / n * (n + n * (n - 1) * pair) - n
    null_sd = len(alphabet) / n * math.sqrt(2 * n * (n - 1) * (pair - pair ** 2) + 4 * n * (n - 1) * (n - 2) * (triple - pair ** 2))
    z = [(null_mean - chi) / null_sd]
    runs = len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", token))
    z.append((runs - 1 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    v = [alphabet.index(c) + 1 for c in folded]
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v) / n
    cov = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / (n - 1)
    r = max(-0.99, min(0.99, cov / spread)) if spread > 0 else 0.99
    z.append((math.atanh(near) - math.atanh(r)) * math.sqrt(n - 3))
    return math.erfc(sum(min(x, secret_scan.Z_MAX) for x in z) / math.sqrt(3) / math.sqrt(2)) / 2


def candidates(text):
    taken = [(m.start(), m.end()) for m in ASSIGN.finditer(text)]
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text):
        end = m.end()
        while end < len(text) and text[end] == "=" and end - m.end() < 2:
            end += 1
        if re.match(r"=*[\"']?\x20*[:=]", text[end:]) or any(a < end and m.start() < b for a, b in taken):
            continue
        if re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", m.group()):
            continue
        yield m.start(), end, m.group()


def discoveries(texts, alpha=0.01):
    """Benjamini-Hochberg by sorting all p-values of a length class (p rounded up to 1/50 of a decade)."""
    tested = []
    for d, t in enumerate(texts):
        for start, end, token in candidates(t):
            p = p_value(token)
            if p is not None:
                b = min(999, max(0, math.floor(-50 * math.log10(max(p, 1e-300)))))
                size = sum(len(token) >= x for x in (24, 32, 40, 64, 128))
                tested.append((size, 10.0 ** (-b / 50), d, start, end))
    out = [[] for _ in texts]
    for size in {x[0] for x in tested}:
        mine = sorted(x for x in tested if x[0] == size)
        passed = [i for i, x in enumerate(mine) if x[1] <= alpha * sum(y[1] <= x[1] for y in mine) / len(mine)]
        limit = max((mine[i][1] for i in passed), default=-1)
        for _, p, d, start, end in mine:
            if p <= limit:
                out[d].append((start, 3, end))
    return out


def scanned(df):
    return [([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in secret_scan.scan(df).orderBy("doc_id").collect()]


def expected(texts):
    found = discoveries(texts)
    return [(base_of(t), sorted(base_of(t) + f)) for t, f in zip(texts, found)]


EDGE = [
    "token=secret=abcdefg", "secret: token: abcdef", "token: password: hunter22", "PassWord :  'aaaaaa' api-key=xxxxxxx apikey=\"1234567", "",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 16 + " AKIAé", "f" * 23, "0" * 24 + "x" + "a" * 30, "é日本 token=é token=日 𝔘𝔘 token=abcdef",
    "token='" + "AKIA" + "Z9" * 10 + "' " + "ab12" * 8, "passwd=" + "0123456789abcdef" * 3 + " api_key:12345 API_KEY: 123456", "tokens=abcdef token =\n abcdef",
    "x_secret_key_number_one_token: 'abcdef123'", "my_very_long_configuration_secret=abcdef"]


def random_texts(seed, n):
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    kinds = [letters, letters + "+/", letters + "-_", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits]
    words = ["user", "Account", "session", "name2", "order", "Item", "https", "report", "2024", "handler", "token", "abc"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 12)):
            k = r.random()
            if k < 0.3:
                parts.append("".join(r.choices(r.choice(kinds), k=r.randrange(18, 90))) + r.choice(["", "", "=", "=="]))
            elif k < 0.7:
                parts.append(r.choice(["", "_", "-", "/"]).join(r.choices(words, k=r.randrange(3, 9))))
            else:
                parts.append(r.choice(["token=", "password: ", "é", "a.b", "x" * 40, "AKIA" + "Q7" * 9, "key", "a1" * 15]))
        out.append(r.choice([" ", "\n", ", "]).join(parts))
    return out


def test_base_and_added_spans_against_brute_force(spark):
    texts = EDGE + random_texts(3, 250)
    got = scanned(simple(spark, list(enumerate(texts))).repartition(5))
    want = expected(texts)
    for t, g, w in zip(texts, got, want):
        assert g == w, t
    added = sum(len(s) - len(b) for b, s in want)
    assert added > 100


def test_random_tokens_are_found_and_names_left_alone(spark):
    r = random.Random(8)
    secret = ["".join(r.choices(string.ascii_letters + string.digits + "+/", k=n)) for n in (24, 32, 40, 48, 64) for _ in range(20)]
    secret = [s for s in secret if re.search("[0-9]", s)]
    names = ["getUserAccountNameForSession2", "internal/operators/search2plan", "2024-01-02-report-final-version", "x1" * 14,
             "com/example/project1/service/handler", "TEST_CASE_NUMBER_00012345", "abcdefghijklmnopqrstuvwxyz0123456789",
             "user-agent-string-parser-v2", "customer_order_line_item_id_2", "UTF8StringBuilderFactoryBean3", "0123456789ABCDEFGHIJKLMNOP"] * 10
    rows = list(enumerate(secret + names))
    got = scanned(simple(spark, rows))
    hits = [bool(s) for _, s in got]
    assert sum(hits[:len(secret)]) >= 0.95 * len(secret)
    assert sum(hits[len(secret):]) <= 0.01 * sum(hits) + 1


def test_awkward_rows_and_long_texts(spark):
    rows = awkward()
    got = scanned(frame(spark, rows))
    assert len(got) == len(rows)
    texts = ["token=abcdef1 " * 20_000 + "f" * 200_000 + " " + "Ab3+" * 50_000, "x" * 1_000_000, "é" * 300_000 + " passwd: zzzzzz1"]
    got = scanned(simple(spark, list(enumerate(texts))))
    assert got == expected(texts)
    assert scanned(frame(spark, [])) == []


def test_query_columns(spark):
    rows = queries.op11_secret_scan(spark, SF_DIR).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(docs) and any(r.n_assign for r in rows)
    for r in rows:
        base = base_of(docs[r.doc_id])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_main_path_is_native(spark):
    plan = queries.op11_secret_scan(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
