"""What a Python worker holds must not grow with the tasks it has run."""

import os
import subprocess
import sys

from shelfwatch.llm.queries import tokenizer_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Runs the work of many tasks in one process; prints the megabytes held after a few and after all, and the threads begun.
TASKS = """
import os, random, re, sys
import pyspark.cloudpickle as cloudpickle
from shelfwatch.llm import common, word_table

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(5)
words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(10_000)]
make, sizes = cloudpickle.dumps(word_table._tokenizer), []
threads = len(os.listdir("/proc/self/task"))
for _ in range(24):
    tokenizer = cloudpickle.loads(make)(sys.argv[1])
    tokenizer.encode_batch_fast(words, add_special_tokens=False)
    del tokenizer
    common.give_back()
    sizes.append(held())
print(sizes[3], sizes[-1], len(os.listdir("/proc/self/task")) - threads)
"""


def test_tokenizer_of_many_tasks():
    env = os.environ | {"PYTHONPATH": ROOT, "OMP_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", TASKS, tokenizer_path("byte_bpe_50k.json")], env=env, capture_output=True, text=True, check=True, timeout=120)
    early, late, threads = map(float, out.stdout.split())
    assert late - early < 15 and threads == 0
