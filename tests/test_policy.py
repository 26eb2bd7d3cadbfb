import os

import pytest
from pyspark.sql import functions as F

from exposure.functions import globs, names
from exposure.operators import policy
from exposure.params import PathPolicy, Surface, effective_mode, effective_placeholder, merge_surfaces

GLOBS = [
    ("", "anything", False), (".env", ".env", True), (".env", ".env.local", False), (".env*", ".env.local", True),
    (".env*", "config.env", False), ("*_secret", "db_secret", True), ("*_secret", "secret_db", False),
    ("foo*bar", "foo123bar", True), ("**/*_backup*", "deep/nested/creds_backup.json", True), ("**/*.bak", "file.bak", True),
    ("foo.log", "dir/sub/foo.log", True), ("**/foo", "foo", True), ("**bar", "bar", True), ("AWS_*", "AWS_FOO:bar", True),
    ("*_end", "foo[bar_end", True), ("pre*suf", "preX:suf", True), ("foo[*", "foo[bar", True), ("*]bar", "foo]bar", True),
    ("pre[*]suf", "pre[XX]suf", True), ("a]*[c", "a]b[c", True), ("*[xSECRET", "foo[xSECRET", True),
    ("*[yy", "dir/xx[yy", True), ("*_secret", "dir/creds_secret", True), ("foo*", "foo123", True), ("*", "x/y", True),
    ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a.c", "abc", False),
    ("f(1)+*.t$", "f(1)+x.t$", True), ("a*b*c", "a1b2c", True), ("a*b*c", "a/b/c", False),
]


def test_globs(rows):
    data = [(i, p, n) for i, (p, n, _) in enumerate(GLOBS)]
    got = dict(rows(data, "i int, p string, n string", "i", globs.glob_matches(F.col("n"), F.col("p"))))
    for i, (p, n, want) in enumerate(GLOBS):
        assert got[i] == want, (p, n)


def test_globs_as_literals(rows):
    got = rows([("deep/x_backup.j",)], "n string", *[globs.glob_matches(F.col("n"), F.lit(p)) for p in ("**/*_backup*", "*.k")])
    assert got == [(True, False)]


def test_key_patterns(rows):
    keys = ["PATH", "PATHS", "LC_ALL", "X_NONSECRET", "API_KEY", "AWS_1_ID", "LESS", ""]
    pats = ["PATH", "LC_*", "*_NONSECRET", "AWS_*_ID", "LESS*", "", "A*P*I*"]
    got = dict(rows([(k,) for k in keys], "k string", "k", globs.key_ignored(F.col("k"), pats)))
    assert got == {"PATH": True, "PATHS": False, "LC_ALL": True, "X_NONSECRET": True, "API_KEY": False, "AWS_1_ID": True, "LESS": True, "": False}
    assert rows([("ab",)], "k string", globs.key_matches(F.col("k"), "ab*b")) == [(True,)]  # prefix and suffix overlap


def test_history_names(rows):
    want = {
        ".bash_history": False, ".bash_history.1": True, ".bash_history.old": True, ".bash_history~": True,
        ".zsh_history.2.gz": True, "zsh_history.backup": True, "my.history.old": True, "foo.bak": False,
        "other.log": False, ".bash_history.swp": False, "foo.bash_history.1": True, "backup.zsh_history.2.gz": True,
    }
    got = dict(rows([(k,) for k in want], "n string", "n", globs.is_rotated_history(F.col("n"))))
    assert got == want


def test_suspicious_names(rows):
    want = {
        "bitwarden_export.json": "bitwarden_json", "MY_Creds.CSV": "bitwarden_csv", "x.1pif": "onepassword_1pif",
        "secrets.txt": "suspicious_filename", "photo.jpg": None, ".env.bak": "suspicious_filename",
    }
    assert dict(rows([(k,) for k in want], "n string", "n", globs.suspicious_format(F.col("n")))) == want


IGNORES = [
    (["node_modules", "", "*.log"], "node_modules/x/y.js", True), (["*.log"], "a/b.log", True), (["*.log"], "keep.txt", False),
    (["*.log", "!important.log"], "important.log", False), (["!important.log", "*.log"], "important.log", True),
    (["dist/"], "dist/something.txt", True), (["dist/"], "dist", False), (["/Makefile"], "Makefile", True),
    (["/Makefile"], "sub/Makefile", False), (["**/node_modules"], "a/b/c/node_modules/x", True),
    (["**/*.tmp"], "foo/bar/baz.tmp", True), (["build/", "!build/important.txt"], "build/important.txt", True),
    (["*.min.js"], "x/app.min.js", True), (["foo/bar"], "src/packages/foo/bar/f", True), (["**/*"], "a/b/c/f.txt", True),
    (["*"], "a", True), (["*", "!keep"], "keep", True), (["/src/*.c"], "src/x.c", False), (["/src"], "src/x.c", True),
    (["#x", "! keep.txt"], "keep.txt", False), (["a/**/z"], "a/b/c/z", True), (["secrets/"], "d/secrets/password.txt", True),
    (["file[0-9].txt"], "d/file7.txt", True), (["file[0-9.txt"], "d/file7.txt", False),
]


def test_ignore_rules(spark):
    paths = spark.createDataFrame([(str(i), rel, False) for i, (_, rel, _) in enumerate(IGNORES)], "root string, rel string, is_dir boolean")
    lines = [(str(i), n, line) for i, (rules, _, _) in enumerate(IGNORES) for n, line in enumerate(rules)]
    rules = policy.rules_from_lines(spark.createDataFrame(lines, "root string, rule_no int, line string"))
    got = {int(r.root): r.ignored for r in policy.mark_ignored(paths, rules).collect()}
    for i, (rule, rel, want) in enumerate(IGNORES):
        assert got[i] == want, (rule, rel)


def test_ignore_files_in_order_and_directories(spark):
    files = spark.createDataFrame(
        [("r", 0, "*.bak\nsecrets/"), ("r", 1, "!keep.bak")], "root string, file_no int, content string"
    )
    paths = spark.createDataFrame(
        [("r", "foo.bak", False), ("r", "keep.bak", False), ("r", "secrets", True), ("r", "secrets", False), ("other", "foo.bak", False)],
        "root string, rel string, is_dir boolean",
    )
    got = {(r.root, r.rel, r.is_dir): r.ignored for r in policy.mark_ignored(paths, policy.ignore_rules(files)).collect()}
    assert got == {
        ("r", "foo.bak", False): True, ("r", "keep.bak", False): False, ("r", "secrets", True): True,
        ("r", "secrets", False): False, ("other", "foo.bak", False): False,
    }


def test_authority(spark):
    p = PathPolicy(("/tmp/dev",), (".env.local", ".env.*.local"), surfaces=(Surface("/tmp/dev", ("**/*",)),))
    df = spark.createDataFrame([("/tmp/dev/.env.local",), ("/tmp/dev/.env",), ("/tmp/dev/src/app.js",), ("/tmp/development/.env.local",), ("/tmp/dev/..x",)], "path string")
    got = {r.path: (r.treat, r.reason) for r in policy.classify(df, p).collect()}
    assert got["/tmp/dev/.env.local"] == (False, policy.CLAIMED_REASON)
    assert got["/tmp/dev/.env"] == (True, "under /tmp/dev") == got["/tmp/dev/src/app.js"]
    assert got["/tmp/development/.env.local"] == got["/tmp/dev/..x"] == (False, policy.OUTSIDE_REASON)
    off = PathPolicy(("/tmp/dev",), roots_enabled=False, surfaces=p.surfaces)
    assert all(r.treat for r in policy.classify(df, off).filter("path like '/tmp/dev/.env%'").collect())


def test_root_table_equals_parameters(spark):
    paths = ["/a/b/.env", "/a/b/c/.env.x", "/a/bb/.env", "/.env", "/a/b/readme"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    roots = spark.createDataFrame([("/a/b", ".env*"), ("/", "nothing")], "root string, pattern string")
    got = {r.path for r in policy.claimed_by_table(df, roots).collect()}
    assert got == {"/a/b/.env", "/a/b/c/.env.x"}


def test_skipped_dirs(rows):
    paths = ["/r/dist/x", "/r/a/node_modules/b/x", "/r/a/dist", "/r/x", "/other/dist/x"]
    got = dict(rows([(p,) for p in paths], "p string", "p", policy.in_skipped_dir(F.col("p"), "/r", ["dist", "node_modules"])))
    assert [p for p in paths if got[p]] == ["/r/dist/x", "/r/a/node_modules/b/x"]
    assert rows([("/x/dist/y",)], "p string", policy.in_skipped_dir(F.col("p"), "/x/dist", ["dist"])) == [(True,)]


def test_locations(rows):
    home = "/Users/t"
    want = {
        "/Users/t/Downloads/bw_export.json": "Downloads/bw_export.json", "/Users/t/a/b/c.x": "a/c.x", "/Users/t/file": "file",
        "/Volumes/USB/secret/creds.json": "Volumes/creds.json", "/etc/passwd": "passwd", "rel/x": "x",
    }
    assert dict(rows([(k,) for k in want], "p string", "p", names.masked_location(F.col("p"), home))) == want


def test_display_names(rows):
    want = {"/a/b/c": "b/c", "/foo": "/foo", "/": "/", "": "", "/a/b/": "a/b", "x": "x"}
    assert dict(rows([(k,) for k in want], "p string", "p", names.display_name(F.col("p")))) == want
    short = {"/a/b/c/": ".../b/c", "abc": ".../abc", "": names.UNKNOWN_PROJECT, "//": names.UNKNOWN_PROJECT}
    assert dict(rows([(k,) for k in short], "p string", "p", names.fallback_name(F.col("p")))) == short


def test_parameters():
    assert merge_surfaces([Surface("/a", ("x",)), Surface("/b"), Surface("/a/", ("w",)), Surface("")]) == [
        Surface("/a", ("w", "x")), Surface("/b")
    ]
    assert [effective_mode(m) for m in ("redact", "", None, "x", "delete")] == ["redact"] + ["delete"] * 4
    assert effective_placeholder("", "h", "f") == "h" and effective_placeholder() == "[REDACTED]"


def test_history_targets(spark):
    paths = ["/h/.bash_history", "/h/.zsh_history.1", "/h/notes", "/h/sub/.bash_history", "/x/extra", "/h/my_hist"]
    df = spark.createDataFrame([(p,) for p in paths * 2], "path string")
    got = [r.path for r in policy.history_targets(df, ["/h"], ["/x/extra", "/gone"], "/h/my_hist").collect()]
    assert got == ["/h/.bash_history", "/h/.zsh_history.1", "/h/my_hist", "/x/extra"]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.env").write_text("K=v")
    (tmp_path / ".env").write_text("K=v")
    (tmp_path / "a" / ".hidden").write_text("1")
    (tmp_path / "a" / "deep" / "er" / "f.txt").write_text("22")
    os.symlink(tmp_path / ".env", tmp_path / "link.env")
    os.symlink(tmp_path / "a", tmp_path / "linked")
    return tmp_path


@pytest.mark.parametrize("shares", [1, 3, 64])
def test_corpus_source(spark, tree, shares):
    from exposure.sources.corpus import CorpusSource

    spark.dataSource.register(CorpusSource)
    df = spark.read.format("corpus").option("roots", str(tree)).option("skipDirs", "node_modules").option("shares", shares).load()
    got = {os.path.relpath(r.path, tree): (r.size, bytes(r.content)) for r in df.collect()}
    assert got == {".env": (3, b"K=v"), "a/.hidden": (1, b"1"), "a/deep/er/f.txt": (2, b"22")}


def test_corpus_parts_and_errors(spark, tree):
    from exposure.sources.corpus import CorpusSource, ListingOptions, Share, _rows

    spark.dataSource.register(CorpusSource)
    lines = b"".join(b"line %d\n" % i for i in range(500)) + b"x" * 3000 + b"\nend"
    (tree / "big.txt").write_bytes(lines)
    for most in (1, 100, 1000):
        df = spark.read.format("corpus").option("roots", str(tree)).option("maxBytes", most).load().filter("path LIKE '%big.txt'")
        parts = [bytes(r.content) for r in df.orderBy("part_no").collect()]
        assert b"".join(parts) == lines and max(map(len, parts)) <= most
    gone = list(_rows(Share([str(tree / "missing")], [str(tree / "gone.txt")]), ListingOptions.of({"roots": str(tree)})))
    assert [(r[0], r[3]) for r in gone] == [(str(tree / "gone.txt"), None), (str(tree / "missing"), None)]
    assert all(r[5].startswith("FileNotFoundError") for r in gone)


def test_corpus_stream_reads_new_files(spark, tree, tmp_path_factory):
    from exposure.sources.corpus import CorpusSource

    spark.dataSource.register(CorpusSource)
    base = tmp_path_factory.mktemp("stream")

    def run():
        q = (
            spark.readStream.format("corpus").option("roots", str(tree)).option("skipDirs", "node_modules")
            .option("settleSeconds", "0").load().select("path").writeStream.format("parquet")
            .option("path", str(base / "out")).option("checkpointLocation", str(base / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return sorted(os.path.relpath(r.path, tree) for r in spark.read.parquet(str(base / "out")).collect())

    first = run()
    assert first == [".env", "a/.hidden", "a/deep/er/f.txt"]
    (tree / "new.txt").write_text("n")
    assert run() == sorted([*first, "new.txt"])


def test_discovery(spark):
    """Skipped and ignored files are left out, nested roots count once, both attributions, errors beside results."""
    from exposure.params import PathPolicy
    from exposure.plans import discovery

    files = [
        ("/h/a/.env", "K=one", None), ("/h/a/node_modules/x/.env", "K=two", None), ("/h/a/old/.env.local", "K=three", None),
        ("/h/a/keep/.env", "K=one\nL=four", None), ("/h/b/.env", "K=out", None), ("/h/a/notes.txt", "K=no", None),
        ("/h/a/.gitignore", "old/", None), ("/h/a/shut", None, "PermissionError: Permission denied"),
    ]
    corpus = spark.createDataFrame(files, "path string, content string, error string").withColumn("modified", F.timestamp_seconds(F.lit(1)))
    place = PathPolicy(roots=("/h/a", "/h/a/keep"), skip_dirs=("node_modules",))
    rules = policy.ignore_rules(discovery.root_rule_files(corpus, place.roots))
    found = discovery.env_files(corpus, place, rules)
    assert sorted({r.path for r in found.collect()}) == ["/h/a/.env", "/h/a/keep/.env"]
    assert discovery.pairs(found).select("hash", "project_id").distinct().count() == 3
    assert discovery.pairs(found, "source").select("project_id").distinct().count() == 1
    names = {r.display_name for r in discovery.projects(found).collect()}
    assert names == {"h/a", "a/keep"}
    bad = discovery.errors(corpus, place)
    assert [r.error for r in bad.collect()] == ["PermissionError: Permission denied"]
    assert tuple(discovery.state(bad).first()) == ("failed", 1)
    none = discovery.errors(corpus, PathPolicy(roots=()))
    assert none.count() == 1 and discovery.env_files(corpus, PathPolicy(roots=())).count() == 0
    assert tuple(discovery.state(discovery.errors(corpus, PathPolicy(roots=("/h/b",)))).first()) == ("completed", 0)
