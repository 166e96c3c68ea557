"""Near-dedup asks the driver for few queries, and leaves it no garbage between them: its memory is bounded, too."""

from vellumite.llm import minhash


def texts():
    """Ten families: a base, an exact copy, a near copy (0.8 and more) and a text that shares two thirds only."""
    for f in range(10):
        base = [f"w{f}x{k}" for k in range(100)]
        near = [*base[:-1], f"other{f}"]
        far = [*base[:80], *(f"far{f}x{k}" for k in range(20))]
        yield from (" ".join(x) for x in (base, base, near, far))


def old_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_near_dedup_is_easy_on_the_driver(spark):
    context = spark.sparkContext
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    before = old_collections(spark)
    context.setJobGroup("near-dedup", "jobs of near-dedup")
    try:
        kept = sorted(r.doc_id for r in minhash.deduplicate(docs, width=5).collect())
        jobs = len(context.statusTracker().getJobIdsForGroup("near-dedup"))
    finally:
        context._jsc.clearJobGroup()
    assert kept == sorted([*range(0, 40, 4), *range(3, 40, 4)])
    assert jobs <= 75 and old_collections(spark) - before >= 3
