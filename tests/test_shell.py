"""Shell words and layer commands, against the standard library's splitter where it has the same rules."""

import random
import shlex

import pytest
from pyspark.sql import functions as F

from telltale import functions as T


def test_words_equal_the_standard_splitter(spark):
    rng = random.Random(2)
    pieces = ["a", "b.c", "-rf", "/x/y", "'q u'", '"d q"', '"e\\"f"', "g\\ h", "k=v", '"it\'s"', "''", "x'y'z", "ü"]
    texts = [rng.choice([" ", "  ", "\t"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.shell_words("t").alias("w")).collect()
    for r in got:
        assert r["w"] == shlex.split(texts[r["i"]]), texts[r["i"]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a && b -c; sudo d 'e;f' | g", [["a"], ["b", "-c"], ["d", "e;f"], ["g"]]),
        ("X=1 Y='2 3' rm f \\\n  g # h", [["rm", "f", "g"]]),
        ("(cd x && rm y) || true", [["cd", "x"], ["rm", "y"], ["true"]]),
        ("if a; then rm b; fi", [["if", "a"], ["rm", "b"], ["fi"]]),
        ("", []),
    ],
)
def test_commands(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.shell_commands("t").alias("c")).first()["c"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("COPY secret.txt /not-a-secret.txt # buildkit", [("added", "/not-a-secret.txt", "secret.txt")]),
        ("RUN /bin/sh -c rm -rf /not-a-secret.txt # buildkit", [("removed", "/not-a-secret.txt", None)]),
        ("COPY --chown=a:b --from=x p/a.txt b.txt /app # buildkit", [("added", "/app/a.txt", "p/a.txt"), ("added", "/app/b.txt", "b.txt")]),
        ('ADD ["my key.pem", "/k/"]', [("added", "/k/my key.pem", "my key.pem")]),
        ("/bin/sh -c #(nop) COPY file:0ab1 in /x/y ", [("added", "/x/y", "file:0ab1")]),
        ("/bin/sh -c apt-get update && rm -rf /var/lib/apt", [("removed", "/var/lib/apt", None)]),
        ("RUN |1 V=2 /bin/sh -c set -e; mv /a /b/ && cp c d", [("removed", "/a", None), ("added", "/b/a", "/a"), ("added", "d", "c")]),
        ('RUN ["rm", "-f", "/z", "/y"]', [("removed", "/z", None), ("removed", "/y", None)]),
        ('RUN ["/bin/bash", "-c", "echo rm; rm /q"]', [("removed", "/q", None)]),
        ("RUN echo 'rm /a' && echo rm", []),
        ("COPY alone", []),
        ("ENV A=rm", []),
        ("", []),
    ],
)
def test_layer_files(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.layer_files("t").alias("f")).first()["f"]
    assert [tuple(f) for f in got] == want


def test_null_commands(spark):
    assert spark.range(1).select(F.explode(T.layer_files(F.lit(None).cast("string")))).count() == 0
