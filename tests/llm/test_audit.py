import random
from itertools import permutations

import pytest

from netbehave.llm import audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Every order applied filter by filter, from (doc_id, text, lang) and (doc_id, quality, toxic)."""
    good = {doc_id for doc_id, quality, _ in labels if quality == 1} - {None}
    toxic = {doc_id for doc_id, _, bad in labels if bad == 1} - {None}
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > least[text],
        }
        rows.append((lang or "", {f for f, failed in fails.items() if failed}, doc_id in good, doc_id in toxic))
    found = {}
    for part in {row[0] for row in rows}:
        own = [row[1:] for row in rows if row[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                out = [row for row in left if letter in row[0]]
                left = [row for row in left if letter not in row[0]]
                shapley[letter] += len(out)
                failing = sum(letter in row[0] for row in own)
                alone = sum(row[0] == {letter} for row in own)
                found[part, "".join(order), step] = [
                    len(left), len(out), failing - len(out), alone,
                    sum(row[1] for row in out), sum(row[2] for row in out), letter,
                ]
        for key, values in found.items():
            if key[0] == part:
                values[-1] = shapley[values[-1]]
    return found


def rows_of(df):
    return {(row["part"], row["filter_order"], row["step"]): list(row)[3:] for row in df.collect()}


@pytest.fixture
def corpus():
    """Texts on both sides of every limit; one has a third of all rows."""
    draw = random.Random(3)
    words = [f"w{n}" for n in range(500)]

    def text():
        n = draw.choice([0, 3, 199, 200, 260])
        some = draw.sample(words, draw.choice([20, 130, 400]))
        body = [draw.choice(some) for _ in range(n)]
        return " ".join(body) + draw.choice(["", "\tA" * 20, " #", " x|"])

    kinds = [text() for _ in range(60)] + [None, ""]
    docs = []
    for doc_id in range(400):
        body = kinds[0] if doc_id % 3 == 0 else draw.choice(kinds)
        docs.append((doc_id, body, draw.choice(["en", "de", "", None])))
    docs += [(7, kinds[1], "en"), (7, kinds[1], "de"), (7, kinds[1], "de"), (None, kinds[1], "en"), (None, kinds[0], None)]
    labels = [(n, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for n in range(0, 400, 2)]
    labels += [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    return docs, labels


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.mark.parametrize(("files", "batches", "store"), [(1, 1, None), (6, 6, None), (7, 2, None), (3, 3, ROCKSDB)])
def test_all_orders_equal_filter_by_filter(spark, tmp_path, corpus, files, batches, store):
    docs, labels = corpus
    if store:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    path = str(tmp_path / "docs.parquet")
    # Ids fall from file to file, so that earlier masks are retracted.
    falling = sorted(docs, key=lambda row: -(row[0] or 0))
    spark.createDataFrame(falling, DOCS).repartition(files).write.parquet(path)
    found = audit.audit(spark, path, spark.createDataFrame(labels, LABELS), batches)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert rows_of(found) == plain(docs, labels)


def test_files_that_come_later_retract_earlier_masks(spark, tmp_path, corpus):
    docs, labels = corpus
    path, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    known = spark.createDataFrame(labels, LABELS)
    late = [row for row in docs if row[0] is not None and row[0] < 150]
    early = [row for row in docs if row not in late]
    spark.createDataFrame(early, DOCS).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(DOCS).parquet(path)
    first = audit.interactions(audit.counters(stream, known, folder, 5))
    assert rows_of(first) == plain(early, labels)
    spark.createDataFrame(late, DOCS).coalesce(1).write.mode("append").parquet(path)
    changes = audit.counters(spark.readStream.schema(DOCS).parquet(path), known, folder, 5)
    assert rows_of(audit.interactions(changes)) == plain(docs, labels)
    assert spark.read.parquet(f"{folder}/changes").where("n < 0").count() > 0


def test_copies_of_one_text_cost_a_row_a_task(spark):
    rows = [(n, "en", 3, b"k" if n % 3 else bytes([n % 50]), False, False) for n in range(3000)]
    schema = "doc_id long, part string, mask int, key binary, good boolean, toxic boolean"
    found = audit.brought_together(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert len(found) <= 4 * (1 + 50 + 2)
    assert sum(row["n"] for row in found) == 3000


def test_odd_documents(spark, tmp_path, odd, none):
    labels = spark.createDataFrame([(1, 1, None, "x")], LABELS + ", text string")
    odd.write.parquet(str(tmp_path / "odd"))
    docs = [tuple(row) for row in odd.select("doc_id", "text", "lang").collect()]
    found = audit.audit(spark, str(tmp_path / "odd"), labels)
    assert rows_of(found) == plain(docs, [(1, 1, None)])
    none.write.parquet(str(tmp_path / "none"))
    assert audit.audit(spark, str(tmp_path / "none"), labels).collect() == []
    nobody = audit.audit(spark, str(tmp_path / "odd"), labels.limit(0))
    assert rows_of(nobody) == plain(docs, [])
