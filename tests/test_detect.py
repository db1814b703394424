import random

from orelode.operators import detect as D
from orelode.operators import findings
from tests.stores import AWS, GITHUB, PEM, SLACK


def test_entropy():
    assert D.shannon(b"A" * 20) == 0 and abs(D.shannon(b"AB" * 8) - 1) < 1e-12 and D.shannon(b"") == 0
    assert D.shannon(b"4Kz9#mQv!8xL@2wP$7yN%1vR^6tB&0s") > 4


def test_redact():
    assert D.redact(AWS.encode()) == "AK" + "IA...CDEF" and D.redact(PEM.encode(), True) == D.redact(PEM.encode()) == "[REDACTED PRIVATE KEY]"
    assert D.redact(b"12345678") == "..." and D.redact(b"123456789") == "1234...6789"


def test_scan():
    line = f"line 1\nline 2\nconst key = '{AWS}';\n".encode()
    (f,) = D.scan_blob(line)
    assert (f[0], f[3], f[4], f[-1]) == ("AWS Access Key", 27, 3, False)
    (f,) = D.scan_blob(b"\0" + line)
    assert (f[3], f[4], f[-1]) == (28, 1, True)
    assert list(D.scan_blob(b"x" * (10 * 1024 * 1024 - 20) + AWS.encode()))
    assert not list(D.scan_blob(b"x" * (10 * 1024 * 1024 - 19) + AWS.encode()))
    both = f"{AWS}{AWS} {GITHUB} {SLACK} {PEM}".encode()
    assert [f[0] for f in D.scan_blob(both)] == ["AWS Access Key"] * 2 + ["GitHub Token", "Slack Token", "Private Key"]
    assert not list(D.scan_blob(b"-----BEGIN PGP PRIVATE KEY BLOCK-----"))


def test_context():
    def words(text):
        i = text.index("@")
        return D.keywords_near(text.encode(), i, i + 1)

    assert words(" token secret api_key @") == ["token", "api_key"]  # separators are used up
    assert words("Password: @ password") == ["password"] and words("my_token_x@") == ["token"]
    assert words("tokens@") == [] and words("secret" + "." * 99 + "@") == [] and words("." + "secret" + "." * 93 + "@") == ["secret"]


def test_columns(spark):
    paths = {"config/.env": 10, "keys/id_rsa": 10, "keys/id_rsa.pub": 0, "a/.env.staging": 10, "creds.env": 0, "x/KEY.PEM": 10, "a/b.key/": 10, "tests/fixtures/sample.txt": -30, "test/fixtures/.env": -20, "contest/attestation/document.txt": 0, "a/b_test.go": -30, "a.test.js/x": -30, "": 0}
    df = spark.createDataFrame([(p, s) for p, s in paths.items()], "path string, want int")
    from pyspark.sql import functions as F

    assert df.where(D.path_score(F.col("path")) != F.col("want")).count() == 0
    agg = spark.createDataFrame([("a", "test/.env"), ("b", "test/x"), ("b", "src/x"), ("c", "test/x"), ("d", None)], "b string, path string").groupBy("b").agg(D.path_score_of_all(F.col("path")).alias("s"))
    assert {r.b: r.s for r in agg.collect()} == {"a": 10, "b": 0, "c": -30, "d": 0}
    e = spark.createDataFrame([(4.6, 25), (4.5, 25), (4.0, 18), (3.2, 10), (3.0, 10), (2.9999999999, 10), (2.5, 0)], "e double, want int")
    assert e.where(D.entropy_score(F.col("e")) != F.col("want")).count() == 0
    t = spark.createDataFrame([(100, "CRITICAL", 4), (90, "CRITICAL", 4), (89, "HIGH", 3), (70, "HIGH", 3), (69, "MEDIUM", 2), (40, "MEDIUM", 2), (39, "LOW", 1)], "s int, want string, rank int")
    assert t.where((D.tier(F.col("s")) != F.col("want")) | (D.tier_rank(F.col("want")) != F.col("rank"))).count() == 0
    assert spark.range(1).select(D.tier_rank(F.lit("?")).alias("r"), D.confidence(F.lit(-5)).alias("lo"), D.confidence(F.lit(95), F.lit(20)).alias("hi")).first()[:] == (0, 0, 100)


def test_both_forms_agree(spark):
    r = random.Random(5)
    pieces = [AWS, GITHUB, SLACK, PEM, "\n", "é", "日", " token ", "\0", "AKIA", "x" * 50]
    blobs = [(f"b{i}", "".join(r.choice(pieces) for _ in range(30)).encode()) for i in range(40)] + [("none", None), ("empty", b"")]
    df = spark.createDataFrame(blobs, "blob_id string, payload binary")
    cols = ["blob_id", "pattern_name", "byte_offset", "line_number", "fingerprint"]
    a = sorted(map(tuple, D.candidates(df).select(*cols).collect()))
    assert a == sorted(map(tuple, D.candidates_sql(df).select(*cols).collect())) and len(a) > 100
    f = findings.scored(D.candidates(df.union(df)))
    assert f.count() == len(a) and set(f.columns).isdisjoint({"candidate", "value"})
    assert {r.id for r in findings.at_least(f, "medium").collect()} >= {r.id for r in findings.at_least(f, "high").collect()}
    own = (D.Pattern("Number", "test", "[0-9]{6}", 40),)
    got = D.candidates(spark.createDataFrame([("x", b"a 123456 b")], "blob_id string, payload binary"), own).collect()
    assert [(g.pattern_name, g.byte_offset) for g in got] == [("Number", 2)]


def test_tier_names():
    import pytest

    assert D.parse_tier("high") == D.parse_tier("HIGH") == "HIGH"
    for bad in ("High", "", "none"):
        with pytest.raises(ValueError):
            D.parse_tier(bad)
