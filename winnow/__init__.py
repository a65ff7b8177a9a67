"""winnow: corpus curation for small language models, written as Spark jobs.

Every step of the curation flow (keys, labelling, resume, shard merge, token
report, byte-pair vocabulary, training blocks, holdout, count-model metrics,
chat prompts, vectors, streaming) is a DataFrame transformation. Modules:

* ``winnow.sources``   - table readers, job rows, JSONL records, sinks
* ``winnow.functions`` - column expressions (keys, JSON text, vectors)
* ``winnow.operators`` - DataFrame -> DataFrame operators
* ``winnow.streaming`` - restartable labelling stream
* ``winnow.plans``     - the registered queries and their SQL oracles
"""

from winnow.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
