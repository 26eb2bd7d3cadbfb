import hashlib

from pyspark.sql import functions as F

from exposure.operators import residue
from exposure.params import PathPolicy, Surface
from exposure.plans import residue_scan, status
from exposure.sources import sinks

KEY = "Kx7pQ9mR2vL8nT4wY6zX3cV5bN1mJ0hGfD9sA7pQ4rW2eT6yU"
NOISE_KEYS = [f"Zx{i}mQ9kR2vL8nT4wY6z{i}cV5bN1mJ0hGfD9sA7" for i in range(4)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_vault_json(rows):
    want = {
        '{"encrypted": true, "items": [{"login":{"password":"%s"}}]}' % KEY: (0, False),
        '{"encrypted": false, "items": [], "folders": []}': (0, True),
        '{"encrypted": false, "items": [], "collections": null}': (0, True),
        '{"encrypted": false, "items": []}': (0, False),
        '{"items": [null, "not a map", {"login": {"password": "%s", "totp": 5}}]}' % KEY: (1, True),
        '{"items": [{"login":{"username":"u","password":"%s"}},{"fields":[{"value":"%s"},3]},{"notes":"x %s y"}]}' % (KEY, KEY, KEY): (3, True),
        '{"items": [7], "encrypted": "yes"}': (0, True),
        '[{"items":[{}]}]': (0, False),
        '{"items":[{}]} tail': (0, False),
        "plain": (0, False),
    }
    got = {t: (h, e) for t, h, e in rows([(t,) for t in want], "t string", "t", residue.vault_json(F.col("t")).hits, residue.vault_json(F.col("t")).is_export)}
    assert got == want


def test_other_detectors(rows):
    def run(fn, t):
        [(h, e)] = rows([(t,)], "t string", fn(F.col("t")).hits, fn(F.col("t")).is_export)
        return h, e

    assert run(residue.vault_csv, f"name,login,Password\n{KEY}") == (1, True)
    assert run(residue.vault_csv, "login password bitwarden") == (0, True)
    assert run(residue.vault_csv, f"password {KEY}") == (0, False)
    assert run(residue.dashlane, "Dashlane") == (0, True)
    assert run(residue.dashlane, f'"username","password"\n{KEY}') == (1, True)
    assert run(residue.onepassword, f'x "password" {KEY}') == (1, True)
    assert run(residue.onepassword, "OnePassword") == (0, False)


def test_text_gate(rows):
    cases = [
        (b"K=hunter2hunt", True), (b"x", True), (b"0123456789abcd", True), (b"", False), (b"\x89PNG" + b"x" * 20, False),
        (b"\xff\xd8" + b"x" * 20, False), (b"PK" + b"x" * 20, False), (b"SQLite format 3", False),
        (b"ab\x00\x00\x00" + b"x" * 20, False), (b"ab\x00\x00" + b"x" * 20, True), (b"\x00" + b"x" * 20, False),
    ]
    data = [(i, len(b), bytearray(b)) for i, (b, _) in enumerate(cases)]
    got = dict(rows(data, "i int, size long, c binary", "i", residue.is_text_file(F.col("size"), F.col("c"))))
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    data = [(11 << 20, bytearray(b"x" * 20))]
    gate = [residue.is_text_file(F.col("size"), F.col("c"), most) for most in (None, 10 << 20)]
    assert rows(data, "size long, c binary", *gate) == [(True, False)]


FILES = [
    ("/h/Downloads/bitwarden_export_test.json", '{"encrypted":false,"items":[{"login":{"password":"%s"}}]}' % KEY),
    ("/h/Downloads/passwords_export.txt", "some=normaldata\nmore"),
    ("/h/Downloads/creds_backup.txt", f"junk junk\nX={KEY}"),
    ("/h/Downloads/bw_export.json", '{"encrypted":false,"items":[{"login":{"password":"short"}}]}'),
    ("/h/Downloads/export.csv", '"username","password"\n"u","%s"' % KEY),
    ("/h/Downloads/generic.log", "log\n" + "\n".join(NOISE_KEYS)),
    ("/h/Downloads/photo.jpg", "just a plain text without anything"),
    ("/h/Downloads/plain_known.txt", f"known {KEY}"),
    ("/h/Downloads/node_modules/secrets.txt", f"known {KEY}"),
    ("/h/Downloads/.env", f"K={KEY}"),
    ("/h/Downloads/app/.env", f"K={KEY}"),
    ("/h/Downloads/skip/secrets.txt", f"K={KEY}"),
    ("/h/Downloads/.gitignore", "skip/\n*.tmp\n"),
    ("/h/elsewhere/secrets.txt", f"K={KEY}"),
]
POLICY = PathPolicy(roots=("/h/Downloads/app",), surfaces=(Surface("/h/Downloads", ("**/*",)),))


def corpus(spark):
    return spark.createDataFrame(
        [(p, bytearray(c.encode()), len(c)) for p, c in FILES], "path string, content binary, size long"
    ).withColumn("modified", F.expr("timestamp'2024-01-01 00:00:00.75'"))


def registry(spark):
    return spark.createDataFrame([(sha(KEY),)], "hash string")


def test_scan(spark):
    from exposure.operators.policy import ignore_rules

    c = corpus(spark)
    rules = ignore_rules(residue_scan.ignore_rule_files(c, POLICY))
    found = residue_scan.scan(c, registry(spark), POLICY, rules, home="/h")
    got = {r.basename: (r.format, r.confidence, r.known_matches, r.entropy_hits) for r in found.collect()}
    assert got == {
        "bitwarden_export_test.json": ("bitwarden_json", "high", 1, 1),
        "passwords_export.txt": ("suspicious_filename", "low", 0, 0),
        "creds_backup.txt": ("suspicious_filename", "high", 1, 2),  # with and without its key
        "bw_export.json": ("bitwarden_json", "low", 0, 0),
        "export.csv": ("dashlane", "high", 1, 1),
        "generic.log": ("generic_high_entropy", "medium", 0, 4),
    }
    row = found.filter("basename = 'export.csv'").first()
    assert row.location == "Downloads/export.csv" and row.last_mod.microsecond == 0
    assert not any(KEY in str(r) for r in found.collect())
    summary = residue_scan.summary(
        found, residue_scan.examined(c, POLICY, rules), residue_scan.scanned_directories(c, POLICY, rules)
    ).first()
    assert summary.findings == 6 and summary.examined == 10 and summary.scanned == 2
    assert summary.sample == ["Downloads/bitwarden_export_test.json", "Downloads/bw_export.json", "Downloads/creds_backup.txt"]


def test_known_always_reports_plain_names(spark):
    found = residue_scan.scan(corpus(spark), registry(spark), POLICY, home="/h", known_always=True)
    assert {"plain_known.txt", ".env", "secrets.txt"} <= {r.basename for r in found.collect()}
    assert "photo.jpg" not in {r.basename for r in found.collect()}


def test_nested_surfaces_report_twice(spark):
    p = PathPolicy(surfaces=(Surface("/h"), Surface("/h/Downloads")))
    found = residue_scan.scan(corpus(spark), registry(spark), p, home="/h")
    assert found.filter("basename = 'export.csv'").count() == 2
    once = residue_scan.scan(corpus(spark), registry(spark), p, home="/h", dedupe=True)
    assert once.filter("basename = 'export.csv'").count() == 1


def test_sinks(spark, tmp_path):
    found = residue_scan.scan(corpus(spark), registry(spark), POLICY, home="/h")
    sinks.write_findings(found.filter("known_matches = 0"), str(tmp_path), "1")
    sinks.write_findings(found, str(tmp_path), "2")
    back = sinks.latest_version(spark, str(tmp_path))
    assert back.count() == found.count() and "path" not in back.columns
    sinks.write_findings(found.limit(0), str(tmp_path), "3")
    assert sinks.latest_version(spark, str(tmp_path)).count() == 0
    found.write.parquet(str(tmp_path / "data" / "4-unfinished"))
    assert sinks.latest_version(spark, str(tmp_path)).count() == 0
    sinks.write_findings(found, str(tmp_path), "3")
    assert sinks.latest_version(spark, str(tmp_path)).count() == found.count()


def test_status(spark):
    found = residue_scan.scan(corpus(spark), registry(spark), POLICY, home="/h")
    [row] = status.overall(residue=residue.summary(found, ["path"])).collect()
    assert row.section == "residue" and f'"findings":{found.count()}' in row.body
    metrics = spark.createDataFrame([("collect", 3)], "stage string, hashes long")
    assert status.run_metrics(metrics, "r1", "rescan", 12).first().run_id == "r1"
