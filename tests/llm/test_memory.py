"""Memory of the corpus operators' Python workers."""

import subprocess
import sys

from labelwright.llm import suffix_dedup

PEAK = """
import random
from labelwright.llm import suffix_dedup as s
peak = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM")) // 1024
rng = random.Random(1)
texts = [rng.randbytes(4000) for _ in range(1000)]
before = peak()
n = sum(int(count.sum()) for _, _, count, _, _ in s.snippets(texts, 200, 50))
print(n, peak() - before)
"""


def test_snippets_take_little_memory():
    n, mb = map(int, subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, check=True).stdout.split())
    assert n == 1000 * 3801 and mb < 100  # 4 MB of texts took 150 MB and more in segments of 1 MB


def test_texts_longer_than_a_segment_have_every_window_once():
    text = bytes(i * i % 251 for i in range(2 * suffix_dedup.SEGMENT + 500))
    seen = sorted(a for _, begin, count, _, _ in suffix_dedup.snippets([b"short", text], 200, 50) for x, n in zip(begin.tolist(), count.tolist()) for a in range(x, x + n))
    assert seen == list(range(len(text) - 199))


def test_batches_of_texts_are_small(spark):
    from labelwright.llm import base

    before = spark.conf.get(base.ROWS_SETTING)
    try:
        spark.conf.set(base.ROWS_SETTING, "10000")
        sizes = base.by_arrow(spark.range(6000).coalesce(1), lambda batches: (b.slice(0, 1) for b in batches), "id long")
        assert sizes.count() >= 3
        spark.conf.set(base.ROWS_SETTING, "500")
        base.smaller_batches(spark)
        assert spark.conf.get(base.ROWS_SETTING) == "500"
    finally:
        spark.conf.set(base.ROWS_SETTING, before)
