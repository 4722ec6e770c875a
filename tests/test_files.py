"""Files and objects: listing, rules, decoding, CSV, counters, errors, leaks."""

import fnmatch
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import luhn_number, token
from veilsift.functions.globs import name_matches, path_matches
from veilsift.operators.registry import all_detectors, build_detectors
from veilsift.plans import report
from veilsift.plans.scan_job import FileSource, ObjectSource, run_scan
from veilsift.sources import csv_cells, files, ranges, walk

NUMBER = luhn_number("45", 16, 4)
CARD = " ".join(NUMBER[i : i + 4] for i in range(0, 16, 4))
MASK = f"**** **** **** {NUMBER[-4:]}"
MAIL = "mia@box.de"


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


#: path -> content, and (type, line, offset, column) of what must be found there.  One aspect a file.
TREE = {
    # lines
    "plain/four.txt": (f"\n\nto {MAIL}\npays {CARD}", [("email", 3, 4, None), ("credit_card", 4, 6, None)]),
    "plain/zero.txt": ("", []),
    # tables: header, no header, upper-case suffix, other delimiter with a quoted line end, no line feed, blank start
    "table/head.csv": (f"key,pan,who\n7,{CARD},{MAIL}\n8,,{MAIL}\n", [("credit_card", 2, 1, "pan"), ("email", 2, 1, "who"), ("email", 3, 1, "who")]),
    "table/none.csv": (f"{MAIL},{CARD}\n", [("credit_card", 1, 1, "col_2"), ("email", 1, 1, "col_1")]),
    "table/BIG.CSV": (f"pan\n{CARD}\n", [("credit_card", 2, 1, "pan")]),
    "table/semi.csv": (f'a;b;who\n7;"x\ny";{MAIL}\n8;z;{MAIL};{MAIL}\n', [("email", 2, 1, "who"), ("email", 4, 1, "who"), ("email", 4, 1, "col_4")]),
    "table/cr.csv": (f"p,q\r{CARD}\n", [("credit_card", 1, 5, None)]),
    "table/late.csv": (f"\n\nkey, ,end\n7,{MAIL},\n", [("email", 4, 1, "col_2")]),
    # encodings
    "bytes/le.txt": (b"\xff\xfe" + f"to {MAIL}\r\n".encode("utf-16-le"), [("email", 1, 4, None)]),
    "bytes/be.txt": (b"\xfe\xff" + f"to {MAIL}\n".encode("utf-16-be"), [("email", 1, 4, None)]),
    "bytes/mark.txt": (b"\xef\xbb\xbf" + CARD.encode(), [("credit_card", 1, 1, None)]),
    "bytes/broken.txt": (b"\xff\xff \xe2\x28\n\n" + MAIL.encode(), [("email", 3, 1, None)]),
    # a name that must not be shown
    "of_mia.q@box.de.txt": (CARD, [("credit_card", 1, 1, None)]),
}
#: Hidden names are names like others, in trees and stores.
HIDDEN = {"_dark/.own.txt": (MAIL, [("email", 1, 1, None)])}
SKIPPED = {"bytes/nul.txt": b"\x00" + CARD.encode(), "bytes/huge.txt": CARD + "\n" + "-" * 1_500_000, "old.bak.json": CARD}
#: Below allowlisted folders, or of a type that is not scanned.
UNSEEN = {"vendor/lib/y.txt": CARD, "kept/down/z.txt": CARD, "code.py": CARD}
LINES = 4 + 0 + 3 + 1 + 2 + 4 + 1 + 4 + 1 + 1 + 1 + 3 + 1


@pytest.fixture
def lake(tmp_path):
    root = tmp_path / "lake"
    for path, (content, _) in {**TREE, **HIDDEN}.items():
        put(root, path, content)
    for path, content in {**SKIPPED, **UNSEEN}.items():
        put(root, path, content)
    return root


RULES = files.FileRules(allow=["kept/**", "vendor", "*.bak.json"], max_mb=1)


def wanted(*trees):
    rows = [("/" + path, *place) for tree in trees for path, (_, places) in tree.items() for place in places]
    rows = [(r[0].replace("of_mia.q@", "o******@") if "@" in r[0] else r[0], *r[1:]) for r in rows]
    return sorted(rows, key=lambda r: (*r[:4], r[4] or ""))


def shown(result, prefix):
    rows = result.findings.collect()
    return sorted(
        ((r["source"].removeprefix(prefix), r["data_type"], r["line"], r["offset"], r["column_name"]) for r in rows),
        key=lambda r: (*r[:4], r[4] or ""),
    )


def test_tree(spark, lake):
    os.symlink(lake / "plain/four.txt", lake / "again.txt")
    os.symlink(lake / "nowhere", lake / "broken.txt")
    os.symlink(lake / "plain", lake / "twin")
    result = run_scan(spark, [FileSource([str(lake)], RULES), FileSource([str(lake / "none")])], all_detectors())
    assert shown(result, str(lake)) == wanted(TREE, HIDDEN)
    stats = result.stats().first()
    assert (stats["files_scanned"], stats["skipped"], stats["errors"]) == (len(TREE) + 1, len(SKIPPED) + 2, 0)
    assert stats["lines_scanned"] == LINES + 1
    assert len(result.failed_sources) == 1 and "nothing to read" in result.failed_sources[0]
    assert (result.exit_status(), result.exit_status("high")) == (1, 3)
    followed = files.FileRules(allow=RULES.allow, max_mb=1, follow_links=True)
    result = run_scan(spark, [FileSource([str(lake)], followed)], build_detectors(only=["credit_card"]))
    errors = [r["error"] for r in result.target_stats.where("error is not null").collect()]
    assert len(errors) == 1 and "broken.txt" in errors[0]
    assert any(s[0].startswith("/twin/") for s in shown(result, str(lake)))


def test_objects(spark, lake):
    odd = {"plainer/p.txt": (CARD, [("credit_card", 1, 1, None)]), "plain x+y%41/é#.txt": (MAIL, [("email", 1, 1, None)])}
    for path, (content, _) in odd.items():
        put(lake, path, content)
    result = run_scan(spark, [ObjectSource("store", str(lake), "", RULES)], all_detectors())
    assert shown(result, "s3://store") == wanted(TREE, HIDDEN, odd)
    stats = result.stats().first()
    # a store has no folders to prune: what lies below an allowlisted one counts as skipped; empty objects do not
    assert (stats["objects_scanned"], stats["skipped"], stats["errors"]) == (len(TREE) + len(odd), len(SKIPPED) + 2, 0)
    some = run_scan(spark, [ObjectSource("store", str(lake), "plain/", RULES)], all_detectors(), dry_run=True)
    assert [r["name"] for r in some.targets.collect()] == ["s3://store/plain/four.txt"]


def test_only_wanted_objects_are_opened(spark, lake):
    contents = files.read_objects(spark, str(lake), "table/", RULES, [".csv"])
    scanned = [os.path.basename(f) for f in contents.select("path").toPandas()["path"]]
    assert sorted(scanned) == sorted(os.path.basename(p) for p in TREE if p.startswith("table/"))
    # file metadata prunes while planning: fewer files per scan than in the listing
    listed = files.open_store(spark, str(lake)).select("path")
    assert contents.rdd.getNumPartitions() <= listed.rdd.getNumPartitions()
    assert "content" not in files.list_objects(spark, str(lake))._jdf.queryExecution().executedPlan().toString()


def test_siblings_of_a_prefix_are_not_listed(spark, lake):
    listed = files.open_store(spark, str(lake), "plain/fo").select("path").collect()
    assert sorted(os.path.basename(r["path"]) for r in listed) == ["four.txt"]  # empty objects are no rows
    put(lake, "plain/fog/_deep/.x.txt", MAIL)
    assert files.list_objects(spark, str(lake), "nowhere/x").count() == 0
    keys = sorted(r["relative"] for r in files.list_objects(spark, str(lake), "plain/fo").collect())
    assert keys == ["plain/fog/_deep/.x.txt", "plain/four.txt"]
    with pytest.raises(FileNotFoundError):
        files.list_objects(spark, f"{lake}/gone", "a/b")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.open_store(spark, f"{lake}/gone", "a/b")


def test_plan_reads_nothing_and_masks_names(spark, lake):
    result = run_scan(spark, [FileSource([str(lake)], RULES)], dry_run=True)
    names = {r["name"].removeprefix(str(lake)): r["size_bytes"] for r in result.targets.collect()}
    assert names["/o******@box.de.txt"] == len(CARD) and "/bytes/huge.txt" not in names
    assert result.exit_status("low") == 0
    total = report.targets_total(result.targets).first()
    assert total["targets"] == len(names) and total["bytes"] == sum(names.values())


def test_unreadable_file_is_an_error_row(spark, lake):
    listing = spark.createDataFrame([(str(lake / "gone.txt"), "gone.txt", 3, False, None)], files.LISTING)
    contents = files.read_tree(files.verdicts(listing, files.FileRules()))
    row = contents.first()
    assert row["content"] is None and row["error"] == "No such file or directory"


def test_lines_of_a_long_log(spark, tmp_path):
    rng = random.Random(3)
    marked = sorted(rng.sample(range(30_000), 5))
    log = ["".join(rng.choices("stuvw ", k=rng.randint(1, 40))) + "." for _ in range(30_000)]
    for i in marked:
        log[i] += f" {CARD}"
    put(tmp_path, "long.log", "\n".join(log))
    rows = run_scan(spark, [FileSource([str(tmp_path)])]).findings.collect()
    assert sorted((r["line"], r["offset"]) for r in rows) == [(i + 1, log[i].index(CARD) + 1) for i in marked]


def covers(glob, path):
    """The rule for a glob with a slash, segment by segment."""
    if not glob:
        return not path
    if glob[0] == "**":
        # a last one also stands for the folder itself
        return any(covers(glob[1:], path[k:]) for k in range(len(path) + 1))
    return bool(path) and fnmatch.fnmatchcase(path[0], glob[0]) and covers(glob[1:], path[1:])


def test_path_globs_equal_the_rule(spark):
    names = ["x", "xy", "b.q", "a+(1)"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n)]
    globs = ["x/**", "**/xy", "**/x/**", "x/*", "*/b.?", "x/**/b.q", "[xb]*/xy", "[!x]*/*", "a+(1)/?", "x", "b.*", "?y", "./x/xy", "x/xy/"]

    def rule(glob, path):
        flat = glob.removeprefix("./").rstrip("/")
        if "/" in flat:
            return covers(flat.split("/"), path.split("/"))
        return any(fnmatch.fnmatchcase(s, flat) for s in path.split("/"))

    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = frame.select("p", *[path_matches([g], F.col("p")).alias(str(i)) for i, g in enumerate(globs)]).collect()
    wrong = [(g, r["p"]) for r in rows for i, g in enumerate(globs) if r[str(i)] != rule(g, r["p"])]
    assert not wrong


def test_absolute_paths_and_names(spark):
    frame = spark.createDataFrame([("u/f", "/mnt/u/f"), ("u/f", "/opt/u/f"), ("scratch/f", "/opt/scratch/f")], "r string, a string")
    got = [r["m"] for r in frame.select(path_matches(["/mnt/**", "scratch"], F.col("r"), F.col("a")).alias("m")).collect()]
    assert got == [True, False, True]
    assert name_matches(["stage.*", "Old_?"], "stage.people") and name_matches(["Old_?"], "x.y", "OLD_7")
    assert not name_matches(["stage.*"], "live.people", "people") and not name_matches([], "people")


def test_nothing_raw_leaves_a_scan(spark, tmp_path):
    mail, ssn, key = "mia.quent@box.de", "204-13-7781", "gh" + "p_" + token(36, 9)
    root = tmp_path / "data"
    put(root, "t/paid.csv", f"nr;by;at;id\n1;{CARD};{mail};{ssn}\n2;{CARD.replace(' ', '-')};;\n")
    put(root, "t/notes.sql", f"-- {ssn} of <{mail}>\nupdate t set pan = '{CARD.replace(' ', '')}';\n")
    put(root, f"{mail}.txt", CARD)
    put(root, "c.txt", f"token {key}\n")
    result = run_scan(spark, [FileSource([str(root)])], build_detectors({"phone": {"enabled": True}}))
    assert result.findings.count() >= 8
    result.write_json(str(tmp_path / "json"))
    result.write_csv(str(tmp_path / "csv"))
    written = "".join(p.read_text() for d in ("json", "csv") for p in (tmp_path / d).rglob("part-*"))
    assert MASK in written
    for raw in (CARD, CARD.replace(" ", ""), mail, "mia.quent", ssn, key, key[4:]):
        assert raw not in written
    with pytest.raises(ValueError, match="refusing to write"):
        report.write_csv(result.findings.withColumn("value", F.lit("x")), str(tmp_path / "no"))


# -------------------------------------------------------- ranges, walks, streams


def encoded(text, name):
    mark = {"utf-8-sig": b"", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(name, b"")
    return mark + text.encode(name)


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be"])
def test_ranges_own_each_line_once(tmp_path, name):
    rng = random.Random(name)
    for trial in range(60):
        lines = ["".join(rng.choices("aé\u0a0a\u010a中\U0001f600\r ", k=rng.choice([0, 1, 3, 40]))) for _ in range(rng.randint(0, 12))]
        text = "\n".join(lines) + rng.choice(["", "\n"])
        put(tmp_path, "f.txt", encoded(text, name))
        path, width = str(tmp_path / "f.txt"), rng.choice([2, 4, 8, 30, 1000])
        size = os.path.getsize(path)
        count = max(1, -(-size // width))
        got = [ranges.read_range(path, n, n == count - 1, width) for n in range(count)]
        assert b"".join(c for s, c in got if c).decode() == text, (trial, width)
        assert all(c.endswith(b"\n") for c in [c for _, c in got if c][:-1])  # whole lines each


def test_a_file_in_ranges_gives_the_findings_of_the_whole(spark, tmp_path):
    rng = random.Random(8)
    body = ["".join(rng.choices("abc é", k=rng.randint(0, 90))) for _ in range(4000)]
    for i in range(0, 4000, 37):
        body[i] = f"{i} {MAIL}"
    body[1234] = "x" * 9000 + f" {CARD}"  # longer than several ranges
    for i, name in enumerate(["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be"]):
        put(tmp_path, f"{i}.log", encoded("\n".join(body), name))
    put(tmp_path, "nul.txt", b"\0" + ("\n" + MAIL).encode() * 3000)
    found = {}
    for width in (1 << 12, 1 << 25):
        rules = files.FileRules(range_bytes=width)
        result = run_scan(spark, [FileSource([str(tmp_path)], rules)], build_detectors(only=["email", "credit_card"]))
        stats = result.stats().first()
        assert (stats["files_scanned"], stats["lines_scanned"], stats["skipped"]) == (4, 16000, 1)
        assert stats["bytes_scanned"] == sum(os.path.getsize(tmp_path / f"{i}.log") for i in range(4))
        found[width] = sorted(map(str, result.findings.collect()))
    assert found[1 << 12] == found[1 << 25] and len(found[1 << 25]) == 4 * (len(range(0, 4000, 37)) + 1)


def test_pruned_folders_are_never_opened(spark, tmp_path):
    put(tmp_path, "a/b/c/d.txt", MAIL)
    put(tmp_path, "shut/x/y.txt", MAIL)
    put(tmp_path, "a/shut/z.txt", MAIL)
    seen = []

    def opened(folders):
        seen.append(sorted(r["relative"] for r in folders.collect()))
        return folders.where("relative not like '%shut'")

    listed = walk.walk(spark, [(str(tmp_path), "")], False, opened)
    assert [r["relative"] for r in listed.collect()] == ["a/b/c/d.txt"]
    assert seen == [["a", "shut"], ["a/b", "a/shut"], ["a/b/c"], []]  # nothing below a shut folder was listed
    os.symlink(tmp_path / "shut", tmp_path / "shut/x/loop")
    os.symlink(tmp_path, tmp_path / "a/up")
    followed = run_scan(spark, [FileSource([str(tmp_path)], files.FileRules(follow_links=True))], build_detectors(only=["email"]))
    assert followed.findings.count() == 3  # links to a folder above are not followed
    plan = files.list_tree(spark, [str(tmp_path)], False, ["shut"])
    assert sorted(r["relative"] for r in plan.collect()) == ["a/b/c/d.txt"]


def test_a_large_folder_comes_in_parts(spark, tmp_path):
    for i in range(250):
        put(tmp_path, f"f{i}.txt", "x")
    assert walk.walk(spark, [(str(tmp_path), "")], chunk=7).count() == 250


def csv_text(rows, bad_at=None):
    lines = [f"{i},{MAIL},note {i}\n" for i in range(rows)]
    if bad_at is not None:
        lines[bad_at] = f"{bad_at},x\ry\n"
    return "id,mail,text\n" + "".join(lines)


def test_a_rejected_table_rolls_back_within_and_beyond_the_spool():
    for bad_at in (None, 5, 9000):
        text = csv_text(10_000, bad_at)
        for spool in (10, 1 << 20, 1 << 30):
            rows = list(csv_cells.file_rows("p", 1, lambda: csv_cells.physical_lines(text), spool))
            stats = [r[4] for r in rows if r[4]]
            assert len(stats) == 1 and stats[0]["lines"] == 10_001 and rows[-1][4]
            tabular = [c for r in rows if r[1] for c in r[3]]
            plain = [c for r in rows if not r[1] for c in r[3]]
            if bad_at is None:
                assert len(tabular) == 30_003 and not plain and not stats[0]["rolled_back"]
            else:
                assert len(plain) == 10_001 and stats[0]["rolled_back"] == bool(tabular)
                assert not tabular or spool == 10 and bad_at == 9000


def test_findings_of_a_table_given_up_late_are_those_of_its_lines(spark, tmp_path, monkeypatch):
    filler = "y" * 3000
    good = "".join(f"{i},{MAIL},{filler}\n" for i in range(12_000))
    put(tmp_path, "late.csv", "id,mail,text\n" + good + f"1,x\r{MAIL}\n")
    assert os.path.getsize(tmp_path / "late.csv") > csv_cells.SPOOL
    result = run_scan(spark, [FileSource([str(tmp_path)])], build_detectors(only=["email"]))
    rows = result.findings.select("line", "column_name").distinct().collect()
    assert len(rows) == result.findings.count() == 12_001 and {r["column_name"] for r in rows} == {None}
    stats = result.stats().first()
    assert (stats["files_scanned"], stats["lines_scanned"], stats["errors"]) == (1, 12_002, 0)


def test_records_are_read_once(monkeypatch):
    opened = []

    def lines():
        opened.append(1)
        return csv_cells.physical_lines(csv_text(50))

    sniffed = []
    monkeypatch.setattr(csv_cells, "guess_delimiter", lambda first: sniffed.append(1) or ",")
    assert sum(len(r[3]) for r in csv_cells.file_rows("p", 1, lines)) == 153
    assert len(opened) == len(sniffed) == 1
