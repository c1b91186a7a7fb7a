"""Python workers need neither the package nor the repository on their path."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})  # the driver's only
from tuneframe.session import local_session
from tuneframe.llm import centroids, decontamination, licenses, minhash, mixing, ngram_filter, prefix_trie, quality, substrings
spark = local_session(cores=2, shuffle_partitions=2)
docs = spark.createDataFrame([(i, f"some words of text {{i % 5}} and more of them " * 9, "s") for i in range(40)], "doc_id long, text string, source string")
bench = spark.createDataFrame([(1, "text 3 and more of"), (2, "tiny")], "item_id long, text string")
turns = spark.createDataFrame([(i, t, "u", f"turn {{t}}") for i in range(9) for t in range(5)], "conv_id long, turn long, role string, text string")
vectors = spark.createDataFrame([(i, [i / 9.0] * 64) for i in range(20)], "vec_id long, embedding array<double>")
labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
print("COUNTS", ngram_filter.score(docs, ~ngram_filter.held_out()).count(), decontamination.leaks(docs, bench).count() > 0, decontamination.decontaminate(docs, bench, max_index_chars=90).count(),
      prefix_trie.prefix_trie(turns).count() > 0, centroids.cluster(vectors).count(), licenses.license_notices(docs).count(), minhash.near_duplicates(docs).count(),
      substrings.clean_texts(docs).count() > 0, mixing.Mix(docs).documents(docs).count() > 0, quality.score(docs, quality.fit(docs, labels)).count())
"""


def test_operators_run_where_only_the_driver_has_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "COUNTS 40 True 32 True 20 0 40 True True 40" in out.stdout, out.stdout[-500:] + out.stderr[-3000:]
