"""Tables between steps: gone when their block ends, each thread's own."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from lanternrank.llm.shared import part_files, scratch


def test_threads_remove_their_own_tables(spark):
    both = Barrier(2, timeout=60)

    def run(k):
        with scratch(spark):
            gone = part_files(spark.range(k + 1), f"gone-{k}")
            with scratch(spark):
                kept = part_files(spark.range(k + 5), f"kept-{k}", keep=True)
            both.wait()
            n = gone.count(), kept.count()
            both.wait()
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, range(2))) == [(1, 5), (2, 6)]
