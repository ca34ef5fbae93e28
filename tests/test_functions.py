import pytest
from pyspark.sql import functions as F

from cmdlens.functions.category import category
from cmdlens.functions.hashing import b64_decode, b64_encode, command_hash
from cmdlens.functions.ngrams import trigrams, trigrams_of
from cmdlens.functions.patterns import PatternError, glob_to_regex, re2_to_java
from cmdlens.functions.text import byte_levenshtein, edit_threshold, program_name, shell_tokens
from cmdlens.functions.timefmt import heat_level, relative_time


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r


def test_hash_matches_sha256_of_utf8(spark):
    import hashlib
    texts = ["git status", "", "ünïcode ✓ cmd", "a" * 10_000]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.h for r in df.select("s", command_hash("s").alias("h")).collect()}
    assert got == {t: hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts}


@pytest.mark.parametrize("text,expected", [
    ("", []), ("a", []), ("ab", []), ("abc", [0x616263]), ("abcd", [0x616263, 0x626364]),
])
def test_trigram_small(spark, text, expected):
    assert one(spark, trigrams("s"), text) == expected
    assert trigrams_of(text) == expected


def test_trigram_checksum(spark):
    # fixed value: the sum of the packed trigrams of this word
    grams = one(spark, trigrams("s"), "testing")
    assert len(grams) == 5 and sum(grams) == 0x22B2525


def test_trigram_multibyte_is_bytes(spark):
    assert one(spark, trigrams("s"), "aé") == trigrams_of("aé") == [(0x61 << 16) | (0xC3 << 8) | 0xA9]


@pytest.mark.parametrize("cmd,prog", [
    ("hg update", "hg"), ("tar xf a.tgz", "tar"), ("df -h", "df"),
    ("/opt/tools/bin/ruby run.rb", "ruby"), ("LANG=C sort names.txt", "sort"),
    ("A=1 B=2 ninja all", "ninja"), ("top", "top"), ("X=1", "X=1"), ("a/ b", ""),
    ("  spaced out", "spaced"),
])
def test_program_name(spark, cmd, prog):
    assert one(spark, program_name("s"), cmd) == prog


@pytest.mark.parametrize("cmd,cat", [
    ("git push", "vcs"), ("docker ps", "containers"), ("sudo reboot", "system"),
    ("vim x", "editor"), ("ssh host", "network"), ("frobnicate", "other"), ("ls", "shell"),
])
def test_category(spark, cmd, cat):
    assert one(spark, category("s"), cmd) == cat


def test_base64_roundtrip(spark):
    df = spark.createDataFrame([("héllo wörld " * 20,)], "s string")
    r = df.select(b64_encode("s").alias("b")).select(F.col("b"), b64_decode("b").alias("d")).first()
    assert "\n" not in r.b and r.d == "héllo wörld " * 20
    assert one(spark, b64_decode("s"), "!!not base64!!") is None


def test_byte_levenshtein(spark):
    df = spark.createDataFrame([("é", "e")], "a string, b string")
    assert df.select(byte_levenshtein("a", "b")).first()[0] == 2


def test_edit_threshold():
    assert [edit_threshold(w) for w in ["ab", "abcde", "abcdefghij", "é"]] == [1, 1, 2, 1]


def test_shell_tokens(spark):
    got = one(spark, shell_tokens("s"), "a/b=c:d,e;f|g&h(i)j[k]l{m}n<o>p  q\tr\ns")
    assert got == list("abcdefghijklmnopq") + ["r\ns"]


@pytest.mark.parametrize("delta_ms,label", [
    (30_000, "A few moments ago"), (90_000, "1 minute ago"), (180_000, "3 minutes ago"),
    (90 * 60_000, "1 hour ago"), (2 * 3_600_000, "2 hours ago"), (25 * 3_600_000, "1 day ago"),
    (48 * 3_600_000, "2 days ago"), (-50_000, "A few moments ago"),
])
def test_relative_time(spark, delta_ms, label):
    now = 1_700_000_000_000
    df = spark.createDataFrame([(now - delta_ms,)], "ts long")
    assert df.select(relative_time("ts", now)).first()[0] == label


def test_heat_level(spark):
    df = spark.createDataFrame([(c,) for c in [0, 1, 2, 3, 5, 6, 10, 11, 20, 21, 99]], "c long")
    assert [r[0] for r in df.select(heat_level("c")).collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_glob_slash_rule(spark):
    rx = glob_to_regex("ls *")
    df = spark.createDataFrame([(c,) for c in ["ls", "ls -la", "ls /tmp", "lsof", "git status"]], "s string")
    assert [r.s for r in df.filter(F.col("s").rlike(rx)).collect()] == ["ls -la"]
    rx2 = glob_to_regex("ls*")
    assert sorted(r.s for r in df.filter(F.col("s").rlike(rx2)).collect()) == ["ls", "ls -la", "lsof"]


@pytest.mark.parametrize("bad", ["[abc", "a\\", "[]", "[a-", "[-a]"])
def test_glob_malformed(bad):
    with pytest.raises(PatternError):
        glob_to_regex(bad)


def test_glob_classes(spark):
    df = spark.createDataFrame([(c,) for c in ["cat", "cbt", "cut", "c/t", "ct"]], "s string")
    for pat, want in [("c[ab]t", ["cat", "cbt"]), ("c[^ab]t", ["c/t", "cut"]), ("c?t", ["cat", "cbt", "cut"]),
                      ("c[a-c]t", ["cat", "cbt"]), ("c\\at", ["cat"])]:
        got = sorted(r.s for r in df.filter(F.col("s").rlike(glob_to_regex(pat))).collect())
        assert got == want, pat


def test_regex_dialect(spark):
    df = spark.createDataFrame([("cd\n",), ("cd",), ("a\x0bb",), ("a b",)], "s string")

    def hits(expr):
        return sorted(r.s for r in df.filter(F.col("s").rlike(re2_to_java(expr))).collect())
    assert hits("^cd$") == ["cd"]                     # RE2: $ is end of text
    assert hits("a\\sb") == ["a b"]                   # RE2: \s excludes vertical tab
    assert hits("^[[:alpha:]]+$") == ["cd"]
    for bad in ["(a)\\1", "a(?=b)", "(?<!x)y", "a(", "[a"]:
        with pytest.raises(PatternError):
            re2_to_java(bad)


def test_regex_dialect_corner_cases(spark):
    """Named groups, scoped flags, escapes and rejected forms, one by one."""
    import pytest
    from pyspark.sql import functions as F

    # (pattern, text, RE2's answer)
    cases = [("a\\vb", "a\nb", False), ("a\\vb", "a\x0bb", True), ("(?U)\\w", "é", False), ("(?m:a$)|b$", "b\n", False),
             ("(?m:a$)|b$", "a\n", True), ("(?<time>x)$", "x\n", False), ("(?P<my_name>x)$", "x", True),
             ("{.*}", "{ab}", True), ("a{,2}", "a{,2}", True), ("\\p{Greek}", "λ", True), ("\\12", "\n", True),
             ("[[:^alpha:]]", "a", False), ("[\\S]", "\x0b", True), ("(?U)a+", "aa", True), ("(?i)É", "é", True)]
    df = spark.createDataFrame([(t,) for _, t, _ in cases], "t string")
    for pattern, text, want in cases:
        got = df.filter(F.col("t") == text).select(F.col("t").rlike(re2_to_java(pattern)).alias("m")).first().m
        assert got == want, pattern
    for pattern in ["a++", "a{2}{3}", "\\e", "(?x)", "(?u)", "a**", "(?=a)", "\\1", "a{2,1}", "[b-a]", "(a{1000}){2}", "*a"]:
        with pytest.raises(PatternError):
            re2_to_java(pattern)
