"""CSV files read block by block against a plain reader of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from choicemeter.sources import readers, records

LISTING = {"recursiveFileLookup": True}


@pytest.fixture
def small_blocks(spark):
    """Blocks of so few bytes that most records go over their ends."""
    keys = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def plain(text):
    """(number, cells) of the data records of a file, by the library; blank lines are no records."""
    found = [r for r in csv.reader(io.StringIO(text, newline="")) if r and any(c.strip() or len(r) > 1 for c in r)]
    return list(enumerate(found[1:])), found[0]


def a_file(rng, columns, rows, end):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow([f"a{i}" for i in range(columns)])
    word = lambda: "".join(rng.choice('ab ,"é\n') for _ in range(rng.randint(1, 12)))
    for i in range(rows):
        if rng.random() < 0.1:
            out.write(end)
        kind = rng.random()
        if kind < 0.1:
            out.write(f'{i}"x,y"z' + ",q" * (columns - 2) + end)  # quotes inside a bare cell
        elif kind < 0.2:
            out.write(f'"{i}' + "\n" * rng.randint(1, 90) + '"' + ",q" * (columns - 1) + end)
        else:
            writer.writerow([f"{i}", *((word() if rng.random() < 0.5 else f"w{rng.randint(0, 99)}") for _ in range(columns - 1))])
    return out.getvalue()


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_whole_files(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    files = {f"f{i}": a_file(rng, rng.randint(2, 4), rng.choice([0, 3, 60]), rng.choice(["\n", "\r\n"])) for i in range(4)}
    for name, text in files.items():
        put(tmp_path / f"{name}.csv", text)
    df = readers.scan_csv(spark, str(tmp_path), columns=["a0", "a1", "a3"], numbered=True, faults=True)
    assert df.rdd.getNumPartitions() > 20
    got = sorted((r._path.rsplit("/", 1)[1][:-4], r._row, r.a0, r.a1, r.a3, r._fault) for r in df.collect())
    cell = lambda row, i: row[i] if i < len(row) and row[i] not in readers.NA_TEXTS else None
    want = sorted((name, n, cell(row, 0), cell(row, 1), cell(row, 3), None) for name, text in files.items() for n, row in plain(text)[0])
    assert got == want and len(want) > 50


def test_one_block_gives_the_same(spark, tmp_path):
    rng = random.Random(9)
    text = a_file(rng, 3, 500, "\n")
    put(tmp_path / "f.csv", text)
    got = sorted((r._row, r.a0) for r in readers.scan_csv(spark, str(tmp_path / "f.csv"), numbered=True).collect())
    assert got == [(n, row[0]) for n, row in plain(text)[0]]


@pytest.mark.parametrize("small", [True, False])
def test_numbers_of_split_files(spark, tmp_path, request, small):
    """Without quoted line ends a row's number comes from the counts of the blocks before it."""
    put(tmp_path / "f.csv", "id,text\n" + "".join(f"{i},t{i}\n" + "\n" * (i % 3) for i in range(400)))
    if small:
        request.getfixturevalue("small_blocks")
    df = readers.scan_csv(spark, str(tmp_path / "f.csv"), numbered=True, multi_line=False)
    assert sorted((r._row, r.id, r.text) for r in df.collect()) == [(i, str(i), f"t{i}") for i in range(400)]
    assert "Window" not in df._jdf.queryExecution().toString()


FAULTY = 'card_id,card_text\nW1,ok\nW2,a text, with an unquoted comma\nW3\nW4,"a ""quoted"", one"\nW5,"two\nlines",x\nW6,5" disk\nW7,"open\nW8,swallowed\n'


@pytest.mark.parametrize("small", [True, False])
def test_faults_are_rejects(spark, tmp_path, request, small):
    put(tmp_path / "cards.csv", FAULTY)
    if small:
        request.getfixturevalue("small_blocks")
    valid, rejects = readers.load_validated(spark, str(tmp_path / "cards.csv"))
    assert sorted((r.card_id, r.card_text) for r in valid.collect()) == [("W1", "ok"), ("W4", 'a "quoted", one'), ("W6", '5" disk')]
    found = {(r._row, r.raw): r.message for r in rejects.collect()}
    pieces = {k: m for k, m in found.items() if k[0] == 6}
    assert all(m == "Fila 8 (Excel): a quote is not closed" for m in pieces.values())
    assert "\n".join(k[1] for k in sorted(pieces, key=lambda k: FAULTY.index(k[1]))).rstrip("\n") == 'W7,"open\nW8,swallowed'
    assert {k: m for k, m in found.items() if k[0] != 6} == {
        (1, "W2,a text, with an unquoted comma"): "Fila 3 (Excel): found 3 cells, the header has 2",
        (2, '{"card_id":"W3"}'): "Fila 4 (Excel): card_text: Input should be a valid string",
        (4, 'W5,"two\nlines",x'): "Fila 6 (Excel): found 3 cells, the header has 2",
    }


def test_a_fault_stops_a_plain_scan(spark, tmp_path):
    put(tmp_path / "f.csv", FAULTY)
    with pytest.raises(Exception, match="found 3 cells"):
        readers.scan_csv(spark, str(tmp_path / "f.csv")).drop("_path").count()


def test_surplus_goes_by_each_file_s_own_header(spark, tmp_path):
    put(tmp_path / "wide.csv", "a,b,c\n1,2,3\n")
    put(tmp_path / "narrow.csv", "b,a\n5,4\n7,6,x\n")
    put(tmp_path / "empty.csv", "")
    put(tmp_path / "header.csv", "c,a\n")
    rows = {(r.a, r.b, r.c, r._record) for r in readers.scan_csv(spark, str(tmp_path), faults=True).collect()}
    assert rows == {("1", "2", "3", None), ("4", "5", None, None), (None, None, None, "7,6,x")}


def test_other_separator(spark, tmp_path):
    put(tmp_path / "f.csv", 'a;b\n1;"x;y"\n2,5;z\n')
    assert sorted((r.a, r.b) for r in readers.scan_csv(spark, str(tmp_path / "f.csv"), sep=";").collect()) == [("1", "x;y"), ("2,5", "z")]


def bytes_read(spark, job):
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(store)}
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.inputBytes() for s in _stages(store) if s.stageId() not in before)


def _stages(store):
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [stages.apply(i) for i in range(stages.size())]


def test_headers_take_the_begin_of_a_file(spark, tmp_path):
    for i in range(2):
        put(tmp_path / f"f{i}.csv", f"id,text{i}\n" + "".join(f"{k},{'x' * 100}\n" for k in range(120_000)))
    whole = 2 * 12_000_000
    kinds = []
    read = bytes_read(spark, lambda: kinds.extend(header for _, header in records.first_records(spark, str(tmp_path), ",")))
    assert sorted(kinds) == [["id", "text0"], ["id", "text1"]] and read < 100_000 < whole
    assert bytes_read(spark, lambda: readers.scan_csv(spark, str(tmp_path), multi_line=False)) < 100_000
    df = readers.scan_csv(spark, str(tmp_path), multi_line=False)
    assert df.agg(F.count("id"), F.count("text1")).first()[:] == (240_000, 120_000)


def test_states_of_blocks(spark):
    """Blocks that keep, turn or settle the state, composed along a file."""
    rng = random.Random(1)
    rows, want = [], {}
    for file in range(3):
        state, base = False, 0
        for start in range(25):
            ends = (rng.random() < 0.5, rng.random() < 0.5)
            begun = (rng.randint(0, 5), rng.randint(0, 5))
            rows.append((file, start * 10, f"p{file}", ends[0], begun[0], ends[1], begun[1], ["a"] if start == 0 else None))
            want[file, start * 10] = (state, base)
            base += begun[state]
            state = ends[state]
        want[file, "open"] = base - 1 if state else -1
    from tests.frames import frame

    got = records.composed(frame(spark, rows, records.SURVEY)).collect()
    assert {(r.file, r.start): (r.inside, r.base) for r in got} == {k: v for k, v in want.items() if k[1] != "open"}
    assert {(r.file, r.open) for r in got} == {(f, want[f, "open"]) for f in range(3)}
