"""Distributed listing, files in parts, and jobs by manifests."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers task code)
from exposure.operators import policy, residue
from exposure.params import PathPolicy, Surface
from exposure.plans import incremental, residue_scan
from exposure.sources import walk

KEY = "Kx7pQ9mR2vL8nT4wY6zX3cV5bN1mJ0hGfD9sA7pQ4rW2eT6yU"


def secret(rng):
    return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(44))


def below(root):
    """What a plain walk finds: sizes by relative path."""
    out = {}
    for d, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if x != "node_modules" and not os.path.islink(os.path.join(d, x))]
        for n in names:
            p = os.path.join(d, n)
            if not os.path.islink(p):
                out[os.path.relpath(p, root)] = os.lstat(p).st_size
    return out


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(2)
    for i in range(40):
        d = tmp_path / f"a{i % 5}" / ("node_modules" if i % 7 == 0 else f".d{i % 3}") / f"e{i % 2}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f".f{i}").write_bytes(b"x" * rng.randrange(50))
    (tmp_path / "top.env").write_text("K=v")
    os.symlink(tmp_path / "a1", tmp_path / "link")
    return tmp_path


@pytest.mark.parametrize("per_task", [64, 1])
def test_listing_is_the_plain_walk(spark, tree, monkeypatch, per_task):
    monkeypatch.setattr(walk, "FOLDERS_PER_TASK", per_task)
    got = walk.listing(spark, [str(tree)], ["node_modules"])
    assert {os.path.relpath(r.path, tree): r.size for r in got.collect()} == below(tree)
    twice = walk.listing(spark, [str(tree), str(tree / "a1"), str(tree)], ["node_modules"])
    assert twice.count() == len(below(tree))


def test_listing_reports_what_it_cannot_open(spark, tree):
    got = walk.listing(spark, [str(tree / "missing"), str(tree / "top.env"), str(tree / "a2")]).filter("error IS NOT NULL")
    assert sorted((os.path.basename(r.path), r.error.split(":")[0]) for r in got.collect()) == [
        ("missing", "FileNotFoundError"), ("top.env", "NotADirectoryError"),
    ]
    assert walk.listing(spark, []).count() == 0


def test_path_filters_reach_the_scan_and_open_no_file(spark, tree):
    files = walk.listing(spark, [str(tree)], ["node_modules"]).filter("size > 10 AND path LIKE '%.f1%'").select("path")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size" in plan and "ReadSchema: struct<path:string,size:bigint,is_dir:boolean>" in plan


def test_flat_folder_is_dealt_by_bytes(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"f{i}").write_bytes(b"line\n" * (i % 20))
    (tmp_path / "huge").write_bytes(b"0123456789\n" * 30_000)
    files = walk.listing(spark, [str(tmp_path)])
    texts = walk.contents(files, max_bytes=20_000, task_bytes=30_000)
    per_task = [r[1] for r in texts.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content"))).collect()]
    assert len(per_task) >= 10 and max(per_task) < 4 * sum(per_task) / len(per_task)
    huge = texts.filter("path LIKE '%huge'").orderBy("part_no").collect()
    assert b"".join(bytes(r.content) for r in huge) == b"0123456789\n" * 30_000 and len(huge) > 10
    assert all(bytes(r.content).endswith(b"\n") for r in huge) and not any(r.whole for r in huge)
    assert texts.filter("whole").count() == 3000


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_parts_are_whole_lines(tmp_path, most):
    rng = random.Random(most)
    data = b"".join(b"y" * rng.choice([0, 1, 5, 63, 64, 200]) + b"\n" for _ in range(60)) + b"end without line end"
    p = tmp_path / "f"
    p.write_bytes(data)
    parts = [walk.read_part(str(p), k, len(data), most) for k in range(-(-len(data) // most))]
    found = [x for x in parts if x is not None]
    assert b"".join(found) == data and all(x.endswith(b"\n") for x in found[:-1])


def test_json_stays_whole_and_missing_files_are_rows(spark, tmp_path):
    doc = json.dumps({"items": [{"notes": "x" * 500}] * 20}, indent=1)
    (tmp_path / "v.json").write_text("\n  " + doc)
    files = walk.listing(spark, [str(tmp_path)])
    (one,) = walk.contents(files, max_bytes=100).collect()
    assert one.whole and bytes(one.content).decode() == "\n  " + doc
    os.remove(tmp_path / "v.json")
    gone = walk.contents(files, max_bytes=100).filter("error IS NOT NULL").collect()
    assert gone and all(r.error.startswith("FileNotFoundError") and r.content is None for r in gone)


def residue_tree(root, seed=3):
    rng = random.Random(seed)
    known = [secret(rng) for _ in range(6)]

    def lines(n, rate):
        return "".join(
            rng.choice([f"export K={rng.choice(known)}", secret(rng), f'"{rng.choice(known)}"'] if rng.random() < rate else ["plain words here", "", "name,login"]) + "\n"
            for _ in range(n)
        )

    texts = {
        "big.txt": lines(900, 0.05), "two_hits.txt": secret(rng) + "\n" + "pad line\n" * 400 + secret(rng) + "\n",
        "three_hits.txt": "\n".join(secret(rng) + "\n" + "pad line\n" * 300 for _ in range(3)),
        "same.txt": (known[0] + "\n" + "pad line\n" * 200) * 5, "my_export.csv": "login\n" + "pad\n" * 500 + "password\n" + secret(rng) + "\n",
        "d.csv": '"username"\n' + "pad\n" * 600 + '"password"\n' + secret(rng), "n.1pif": "pad\n" * 500 + '"password"\n' + secret(rng),
        "vault.json": json.dumps({"encrypted": False, "items": [{"login": {"password": secret(rng)}, "notes": known[1]}] * 30}, indent=1),
        "rows.json": "".join(json.dumps({"password": known[2], "n": i}) + "\n" for i in range(200)), "long.txt": "w" * 3000 + known[3] + "\n" + lines(100, 0.2),
        "my_password.txt": "nothing\n" * 300, "bin.txt": "\x00\x00\x00" + lines(200, 0.5), "empty.txt": "", "skipped.log": lines(50, 0.9),
    }
    os.makedirs(root, exist_ok=True)
    for name, text in texts.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    return known


def as_rows(df):
    return sorted(tuple(r) for r in df.select("path", "format", "confidence", "known_matches", "entropy_hits", "size").collect())


def registry_of(spark, known):
    return spark.createDataFrame([(k,) for k in known], "k string").select(F.sha2("k", 256).alias("hash"))


@pytest.mark.parametrize("always", [False, True])
def test_small_parts_give_the_findings_of_whole_files(spark, tmp_path, always):
    known = residue_tree(tmp_path / "s")
    files, registry = walk.listing(spark, [str(tmp_path)]), registry_of(spark, known)
    place = PathPolicy(surfaces=(Surface(str(tmp_path)),))
    rules = policy.rules_from_lines(spark.createDataFrame([(str(tmp_path), 0, "*.log")], "root string, rule_no int, line string"))
    plain = files.select("path", "modified", "size").join(walk.contents(files).select("path", "content"), "path")
    want = as_rows(residue_scan.scan(plain, registry, place, rules, known_always=always))
    for most in (1 << 30, 4096, 700):
        found = residue_scan.scan_listing(files, registry, place, rules, known_always=always, max_bytes=most)
        assert as_rows(found) == want, most
    names = {os.path.basename(w[0]): w for w in want}
    assert "skipped.log" not in names and names["vault.json"][1] == residue.FORMAT_VAULT_JSON and names["three_hits.txt"][4] == 3


def test_errors_are_rows_of_the_scan(spark, tmp_path):
    residue_tree(tmp_path / "s")
    files = walk.listing(spark, [str(tmp_path), str(tmp_path / "none")])
    os.remove(tmp_path / "s" / "big.txt")
    found = residue_scan.scan_listing(files, registry_of(spark, ["x"]), PathPolicy(surfaces=(Surface(str(tmp_path)),)))
    bad = {os.path.basename(r.path): r for r in found.filter("error IS NOT NULL").collect()}
    assert set(bad) == {"none", "big.txt"} and all(r.format is None and r.known_matches is None for r in bad.values())
    assert found.filter("error IS NULL").count() > 3


def test_residue_steps_equal_the_batch(spark, tmp_path):
    root, state = str(tmp_path / "s"), str(tmp_path / "state")
    registry = registry_of(spark, residue_tree(root))
    place = PathPolicy(surfaces=(Surface(root),))

    def batch():
        return as_rows(residue_scan.scan_listing(walk.listing(spark, [root]), registry, place))

    def step(basis="1"):
        return incremental.residue_step(walk.listing(spark, [root]), state, registry, place, basis=basis, max_bytes=2000)

    with pytest.raises(ValueError):
        incremental.current(spark, state)
    assert step() == 1 and as_rows(incremental.current(spark, state)) == batch()
    # Moved in with an old time, changed with an older time, and gone.
    rng = random.Random(9)
    for name in ("old.txt", "two_hits.txt"):
        with open(f"{root}/{name}", "w") as f:
            f.write("\n".join(secret(rng) for _ in range(5)))
        os.utime(f"{root}/{name}", (1000, 1000))
    os.remove(f"{root}/same.txt")
    assert step() == 2
    worked = spark.read.parquet(*[f"{state}/results/data/{d}" for d in os.listdir(f"{state}/results/data") if d.startswith("000000000002")])
    assert {os.path.basename(r.path) for r in worked.collect()} == {"old.txt", "two_hits.txt"}
    assert as_rows(incremental.current(spark, state)) == batch()
    assert step() == 3 and step() == 4 and as_rows(incremental.current(spark, state)) == batch()
    incremental.compact(spark, state, f"{state}-2")
    assert as_rows(incremental.current(spark, f"{state}-2")) == batch()
    assert step("2") == 5
    assert sum(1 for d in os.listdir(f"{state}/results/data") if d.startswith("000000000005")) == 1
    assert as_rows(incremental.current(spark, state)) == batch()


def test_a_failed_step_is_done_again(spark, tmp_path):
    root, state = str(tmp_path / "s"), str(tmp_path / "state")
    residue_tree(root)
    listing = walk.listing(spark, [root])

    def fail(changed):
        raise RuntimeError("lost")

    work = lambda changed: changed.select("path", F.lit(1).alias("n"))
    incremental.step(listing.filter("size > 5000"), state, work)
    with pytest.raises(RuntimeError):
        incremental.step(listing, state, fail)
    assert incremental.current(spark, state).count() == listing.filter("size > 5000").count()
    # Results that no manifest follows don't count.
    incremental.sinks.write_version(listing.select("path", F.lit(2).alias("n")), f"{state}/results", f"{2:012d}")
    assert {r.n for r in incremental.current(spark, state).collect()} == {1}
    assert incremental.step(listing, state, work) == 2
    assert incremental.current(spark, state).count() == listing.count() and {r.n for r in incremental.current(spark, state).collect()} == {1}
