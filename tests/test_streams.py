import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slideloom.operators import chunks, embed, tables
from slideloom.plans import registry
from slideloom.sources import slide_store, watch
from slideloom.streaming import events as stream

START = datetime(2024, 1, 1)


def at(ms):
    return START + timedelta(milliseconds=ms)


def drain(df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name).collect()


def source(spark, tmp_path, rows, schema):
    """Rows in one file, and a far later row in a second one so that the watermark passes."""
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_debounce_and_queue(spark, tmp_path):
    rows = [(1, at(0), "add", "a.pptx"), (2, at(500), "change", "a.pptx"), (3, at(999), "change", "a.pptx"), (4, at(0), "add", "b.pptx"), (5, at(501), "unlink", "b.pptx"), (6, at(0), "add", "n.txt"), (7, at(0), "add", "x/node_modules/c.pptx")]
    folder = source(spark, tmp_path, rows, stream.SCHEMA)
    source(spark, tmp_path, [(99, START + timedelta(days=2), "add", "late.pptx")], stream.SCHEMA)
    got = drain(stream.debounce_events(stream.read_file_events(spark, folder)), "quiet", tmp_path)
    assert sorted(r.event_id for r in got) == [3, 4, 5, 6]
    # the batch twin leaves a gap of exactly 500 ms merged as well
    batch = tables.debounce_batch(spark.read.parquet(folder).where("path NOT LIKE '%node%' AND event_id < 99"))
    assert sorted(r.event_id for r in batch.collect()) == [3, 4, 5, 6]
    more = [(20, at(10_000), "add", "d/e/a.pptx"), (21, at(10_500), "unlinkDir", "d/e"), (22, at(10_000), "add", "d/eb.pptx"), (23, at(10_000), "change", "d/c.pptx"), (24, at(13_000), "change", "d/c.pptx")]
    source(spark, tmp_path, more, stream.SCHEMA)
    queue = drain(stream.process_queue(stream.read_file_events(spark, folder)), "queue", tmp_path)
    assert sorted(r.event_id for r in queue) == [3, 22, 23, 24]


def test_windows_equal_the_batch(spark, tmp_path):
    rows = [(i, at(i * 1000), "add" if i % 3 else "change", "a") for i in range(30)]
    folder = source(spark, tmp_path, rows, stream.SCHEMA)
    got = drain(stream.window_counts(stream.read_file_events(spark, folder), "10 seconds"), "windows", tmp_path, "complete")
    want = tables.event_windows(spark.read.parquet(folder), "10 seconds").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_cache_statistics_follow_the_log(spark, tmp_path):
    folder = source(spark, tmp_path, [(True,), (False,), (True,)], "hit boolean")
    got = drain(stream.cache_stats_stream(spark.readStream.schema("hit boolean").parquet(folder)), "stats", tmp_path, "complete")
    assert got == tables.cache_stats(spark.read.parquet(folder)).collect()


def test_a_file_settles_once(spark, tmp_path):
    rows = [("a", 10, at(0)), ("a", 20, at(50)), ("a", 20, at(100)), ("a", 20, at(160)), ("a", 20, at(300)), ("a", 30, at(400)), ("a", 30, at(500)), ("b", 1, at(0)), ("b", 2, at(500))]
    schema = "path string, size long, ts timestamp"
    folder = source(spark, tmp_path, rows, schema)
    got = drain(stream.settle_writes(spark.readStream.schema(schema).parquet(folder)), "settled", tmp_path)
    assert sorted((r.path, r.size, r.ts) for r in got) == [("a", 20, at(160)), ("a", 30, at(500))]
    # a far later poll lets the watermark pass: the file without further polls settles by its timer
    source(spark, tmp_path, [("z", 1, START + timedelta(days=2))], schema)
    got = drain(stream.settle_writes(spark.readStream.schema(schema).parquet(folder)), "settled2", tmp_path)
    assert sorted((r.path, r.size, r.ts) for r in got) == [("a", 20, at(160)), ("a", 30, at(500)), ("b", 2, at(600))]
    batch = stream.settle_batch(spark.createDataFrame(rows, schema))
    assert sorted((r.path, r.size, r.ts) for r in batch.collect()) == [("a", 20, at(160)), ("a", 30, at(500)), ("b", 2, at(600))]


def test_indexing_a_stream_is_safe_to_repeat(spark, tmp_path):
    schema = "file_path string, slide_number int, slide_text string"
    folder = source(spark, tmp_path, [("a", 1, "x y"), ("a", 1, "x y"), ("b", 1, "z")], schema)
    store = str(tmp_path / "store")
    for k in range(2):
        stream.index_stream(spark.readStream.schema(schema).parquet(folder), store, str(tmp_path / f"ck{k}")).awaitTermination(120)
        got = slide_store.read_slides(spark, store)
        assert got.count() == 2 and got.where(F.size("embedding") == 64).count() == 2


def test_the_tree_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        depth = rng.randrange(1, 5)
        parts = [rng.choice("abc") for _ in range(depth)]
        kind = rng.choices(["add", "change", "unlink", "addDir", "unlinkDir"], (4, 1, 1, 6, 0.4))[0]
        path = "/".join(parts) + ("" if "Dir" in kind else f"/f{rng.randrange(3)}")
        rows.append((i, at(i * 100), kind, path))
    files_of, folders = {}, set()
    for _, _, kind, path in rows:  # plain replay of the events in order
        if kind == "unlinkDir":
            files_of = {p: d for p, d in files_of.items() if p != path and not p.startswith(path + "/")}
        elif kind == "unlink":
            files_of.pop(path, None)
        else:
            files_of[path] = kind == "addDir"
    folders = {p for p, d in files_of.items() if d}
    up = lambda p: [p[:i] for i, c in enumerate(p) if c == "/"]
    want = sorted((p, d) for p, d in files_of.items() if all(a in folders for a in up(p)))
    assert sorted(map(tuple, chunks.live_tree(spark.createDataFrame(rows, stream.SCHEMA)).collect())) == want and len(want) > 30 and len(want) < len(files_of)
    rng.shuffle(rows)
    folder, store = str(tmp_path / "in"), str(tmp_path / "tree")
    for part in range(6):
        spark.createDataFrame(rows[part * 250 : part * 250 + 250], stream.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        source_rows = spark.readStream.schema(stream.SCHEMA).parquet(folder)
        stream.live_tree_stream(source_rows, store, str(tmp_path / "ck"), late="1 hour", tidy_every=2).awaitTermination(240)
    assert sorted(map(tuple, stream.read_live_tree(spark, store).collect())) == want
    # a far later event: what is not in the tree goes from the store
    for k in range(2):
        spark.createDataFrame([(9000 + k, START + timedelta(days=2), "add", f"top{k}")], stream.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream.live_tree_stream(spark.readStream.schema(stream.SCHEMA).parquet(folder), store, str(tmp_path / "ck"), late="1 hour", tidy_every=2).awaitTermination(240)
    assert sorted(map(tuple, stream.read_live_tree(spark, store).collect())) == sorted([*want, ("top0", False), ("top1", False)])
    assert slide_store.read_slides(spark, store).count() == len(want) + 2


def test_decks_are_indexed_as_they_come(spark, tmp_path):
    folder = tmp_path / "decks"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.pptx").write_bytes(registry._deck("one\ntwo"))
    (folder / "bad.pptx").write_bytes(b"no deck")
    store = str(tmp_path / "store")
    for want in (2, 3):
        stream.index_files(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination(120)
        got = slide_store.read_slides(spark, store)
        assert got.count() == want and got.where("size(embedding) <> 64").count() == 0
        (folder / "sub" / "c.pptx").write_bytes(registry._deck("three"))
    assert slide_store.read_slides(spark, store + "-unread").count() == 1


def test_changes_of_a_folder_become_events(spark, tmp_path):
    root, state = tmp_path / "root", tmp_path / "listings"
    (root / "old").mkdir(parents=True)
    (root / "old" / "a.pptx").write_bytes(b"1")
    (root / "b.pptx").write_bytes(b"1")

    def run(name, initial=False):
        stream_of = watch.watch_folder(spark, str(root), f"{state}-{name}", initial)
        stream_of.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination(120)
        rows = spark.read.schema(watch.EVENT_SCHEMA).parquet(str(tmp_path / name)).orderBy("event_id").collect()
        return [(r.type, r.path) for r in rows]

    assert run("out") == []
    (root / "new" / "_deep").mkdir(parents=True)
    (root / "new" / "_deep" / "_c.pptx").write_bytes(b"12")
    (root / "new" / "node_modules").mkdir()
    (root / "b.pptx").write_bytes(b"123")
    (root / "old" / "a.pptx").unlink()
    first = [("unlink", "old/a.pptx"), ("change", "b.pptx"), ("addDir", "new"), ("addDir", "new/_deep"), ("add", "new/_deep/_c.pptx")]
    assert run("out") == first
    assert run("out") == first  # nothing has changed
    (root / "old").rmdir()
    (root / "new" / "_deep" / "_c.pptx").unlink()
    (root / "new" / "_deep").rmdir()
    (root / "new" / "_deep").write_bytes(b"now a file")
    assert run("out") == [*first, ("unlinkDir", "old"), ("unlink", "new/_deep/_c.pptx"), ("unlinkDir", "new/_deep"), ("add", "new/_deep")]
    assert run("all", initial=True) == [("add", "b.pptx"), ("addDir", "new"), ("add", "new/_deep")]
    assert len(list(tmp_path.joinpath("listings-out").iterdir())) <= 3


def plain_queue(rows, delay):
    """event_id of the released work by one pass over the events in order of time."""
    waiting, out = {}, []
    for number, ts, kind, path in sorted(rows, key=lambda r: (r[1], r[0])):
        for p in [p for p, (t, _) in waiting.items() if t + delay <= ts]:
            out.append(waiting.pop(p)[1])
        if kind == "unlinkDir":
            for p in [p for p in waiting if p.startswith(path + "/")]:
                del waiting[p]
        elif kind == "unlink":
            waiting.pop(path, None)
        elif kind in ("add", "change") and path.endswith(".pptx"):
            waiting[path] = (ts, number)
    return sorted(out + [n for _, n in waiting.values()])


def test_work_below_one_root_is_spread(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["add", "change", "unlink", "unlinkDir"]
    rows = []
    for i in range(3000):
        kind = rng.choices(kinds, (5, 4, 2, 1))[0]
        folder = f"/a/{rng.randrange(3)}/{rng.randrange(3)}"
        rows.append((i, at(rng.randrange(0, 60_000, 250)), kind, folder[: rng.choice([4, 6])] if kind == "unlinkDir" else f"{folder}/f{rng.randrange(4)}{rng.choice(['.pptx', '.txt'])}"))
    want = plain_queue(rows, timedelta(seconds=2))
    assert sorted(r.event_id for r in stream.process_queue(spark.createDataFrame(rows, stream.SCHEMA)).collect()) == want
    rng.shuffle(rows)
    folder = str(tmp_path / "in")
    for part in (rows[:1000], rows[1000:], [(-1, START + timedelta(days=2), "add", "late.pptx")]):
        spark.createDataFrame(part, stream.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    got = drain(stream.process_queue(spark.readStream.schema(stream.SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)), "spread", tmp_path)
    assert sorted(r.event_id for r in got) == want
    # 10^5 paths below one root: no key has more than a share
    many = spark.range(100_000).select(F.col("id").alias("event_id"), F.lit(START).alias("ts"), F.lit("add").alias("type"), F.format_string("/root/d/f%d.pptx", "id").alias("path"))
    plan = stream.process_queue(many.union(many.where("event_id = 7").selectExpr("event_id + 1000000", "ts + INTERVAL 1 SECOND", "'unlinkDir'", "'/root/x'")))
    assert plan.count() == 100_000
    assert stream.process_queue(many.union(many.where("event_id = 7").selectExpr("event_id + 1000000", "ts + INTERVAL 1 SECOND", "'unlinkDir'", "'/root'"))).count() == 0


def test_failures_are_tried_again_and_deletes_apply(spark, tmp_path):
    schema = "file_path string, slide_number int, slide_text string, change string"
    folder, store, tries = str(tmp_path / "in"), str(tmp_path / "store"), tmp_path / "tries"
    tries.mkdir()

    def embedder(texts):
        for t in texts:
            if t.startswith("hard"):
                own = tries / t
                n = len(own.read_text()) if own.exists() else 0
                own.write_text("x" * (n + 1))
                if t != "hard forever" and n >= 2:
                    continue
                raise ValueError(t)
        return [[float(len(t)), 1.0] for t in texts]

    def step(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream.index_stream(spark.readStream.schema(schema).parquet(folder), store, str(tmp_path / "ck"), embedder, batch_size=1, attempts=4, waits=(0.0,)).awaitTermination(120)
        failed = slide_store.read_slides(spark, store + "-failures")
        return sorted((r.file_path, r.slide_number) for r in slide_store.read_slides(spark, store).collect()), sorted((r.file_path, r.attempts, r.due is not None) for r in failed.collect())

    assert step(("d/a", 1, "easy", None), ("d/a", 2, "hard but works", None), ("d/b", 1, "hard forever", None)) == ([("d/a", 1)], [("d/a", 1, True), ("d/b", 1, True)])
    assert step(("e/c", 1, "more", None)) == ([("d/a", 1), ("e/c", 1)], [("d/a", 2, True), ("d/b", 2, True)])
    assert step(("e/c", 2, "more", None)) == ([("d/a", 1), ("d/a", 2), ("e/c", 1), ("e/c", 2)], [("d/b", 3, True)])
    assert step(("e/c", None, None, "delete"), ("e/c", 3, "again", None)) == ([("d/a", 1), ("d/a", 2), ("e/c", 3)], [("d/b", 4, False)])
    assert step(("d", None, None, "delete_folder")) == ([("e/c", 3)], [])


def test_calls_keep_to_the_budget_of_all_tasks(spark, tmp_path):
    def embedder(texts):
        (tmp_path / f"{time.time_ns()}-{random.random()}").touch()
        return [[1.0] for _ in texts]

    rows, paced = embed.paced(spark.range(24).select(F.col("id"), F.lit("x").alias("slide_text")), embedder, per_minute=240, tasks=4)
    good, failed = embed.embed_slides(rows, paced, batch_size=1, waits=())
    assert good.count() == 24 and failed.count() == 0
    calls = sorted(int(p.name.split("-")[0]) / 1e9 for p in tmp_path.iterdir())
    assert len(calls) == 24
    assert all(sum(t <= u < t + 3 for u in calls) <= 240 * 3 / 60 + 4 for t in calls) and calls[-1] - calls[0] > 4


def test_an_index_follows_its_folder(spark, tmp_path):
    root, store = tmp_path / "decks", str(tmp_path / "store")
    for name, text in (("x/a.pptx", "one\ntwo\nthree"), ("x/_b.pptx", "four"), ("y/c.pptx", "five"), ("y/note.txt", "six")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(registry._deck(text))

    def step():
        stream.index_folder(spark, str(root), str(tmp_path / "listings"), store, str(tmp_path / "ck")).awaitTermination(240)
        return sorted((r.file_path, r.slide_number, r.text) for r in slide_store.read_slides(spark, store).collect())

    assert step() == [("x/_b.pptx", 1, "four"), ("x/a.pptx", 1, "one"), ("x/a.pptx", 2, "two"), ("x/a.pptx", 3, "three"), ("y/c.pptx", 1, "five")]
    (root / "x/a.pptx").write_bytes(registry._deck("uno"))
    (root / "y/c.pptx").unlink()
    (root / "y/note.txt").unlink()
    (root / "y").rmdir()
    (root / "bad.pptx").write_bytes(b"no deck")
    assert step() == [("x/_b.pptx", 1, "four"), ("x/a.pptx", 1, "uno")]
    assert [r.file_path for r in slide_store.read_slides(spark, store + "-unread").collect()] == ["bad.pptx"]
