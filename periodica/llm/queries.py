"""The registered queries of the text operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm import byte_bpe, conversation_repair, decontamination, fingerprints, grammar_output, licenses, ngram_join, ngram_trie, periodic_runs, secret_scan, sharding, suffix_dedup, toxicity
from periodica.llm.common import lean_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: A-Z to a-z only, as SQL over a column ``text``.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANK = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"


@query
def op1_grammar_output(spark, folder):
    """Token ids of every document, written as grammar-compressed shards and read back."""
    return grammar_output.written_and_read(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op2_byte_bpe(spark, folder):
    """Token ids of every document by shuffled distinct words, and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digest(byte_bpe.decode(encoded, path))


@query
def op3_ngram_join(spark, folder):
    """Groups of documents whose five-word shingle sets are 75 % alike."""
    return ngram_join.components(table(spark, folder, "documents"))


SQL["op3_ngram_join"] = f"""
with recursive d as (select doc_id, {BLANK} as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') as g
  from d, unnest(range(0, len(w) - least(5, len(w)) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s as a join s as b using (g) where a.doc_id <> b.doc_id group by all),
links as (select a, b from common join n as x on x.doc_id = a join n as y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as node, doc_id as root from n union select b, root from reach join links on a = node)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(min(root), d.doc_id)::bigint as component_id
from d left join n using (doc_id) left join reach on node = d.doc_id group by d.doc_id, n
"""


@query
def op4_ngram_trie(spark, folder):
    """Log10 probability of every document under a bigram model in Elias-Fano tries."""
    return ngram_trie.scores(table(spark, folder, "documents"))


@query
def op5_licenses(spark, folder):
    """License phrases and notices in every document, by votes along diagonals."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op6_toxicity(spark, folder):
    """Toxicity score of every document, learned from labelled rows outside the held-out quarter."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels, toxicity.training_id))
    return scored.select("doc_id", (~toxicity.training_id(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@query
def op7_secret_scan(spark, folder):
    """Secrets in every document, by pattern and by windows of high entropy."""
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


@query
def op8_fingerprints(spark, folder):
    """Bottom-k fingerprints of every document and of its edited text."""
    return fingerprints.edited_pairs(table(spark, folder, "documents"))


@query
def op9_suffix_dedup(spark, folder):
    """Documents without the bytes of 100-byte strings that start earlier."""
    return suffix_dedup.digest(suffix_dedup.repeats(table(spark, folder, "documents")))


SQL["op9_suffix_dedup"] = """
with t as (select doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, i, substr(h, 2 * i + 1, 200) as g from t, unnest(range(0, n - 99)) as u(i)),
r as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from s),
c as (select distinct doc_id, i + j as pos from (select doc_id, i from r where k > 1) as x, unnest(range(0, 100)) as u(j)),
m as (select doc_id, count(*) as n_removed, count(*) filter (where before is null or pos <> before + 1) as n_spans
  from (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from c) as y group by doc_id),
kept as (select p.doc_id, string_agg(substr(h, 2 * i + 1, 2), '' order by i) as h
  from (select doc_id, h, unnest(range(0, n)) as i from t) as p anti join c on c.doc_id = p.doc_id and c.pos = p.i group by p.doc_id)
select t.doc_id, t.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.h, ''))) as kept_sha256
from t left join m using (doc_id) left join kept using (doc_id)
"""


@query
def op10_decontamination(spark, folder):
    """Words of every document that lie in windows of benchmark items."""
    return decontamination.digest(decontamination.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


SQL["op10_decontamination"] = f"""
with d as (select doc_id, {ALNUM} as w from documents),
b as (select item_id::varchar as item_id, {ALNUM} as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as g
  from b, unnest(range(0, len(w) - least(10, len(w)) + 1)) as t(i) where len(w) > 0),
grams as (
  select doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') as g
  from d, (select distinct k from win) as ks, unnest(range(0, greatest(0, len(w) - k + 1))) as t(i)),
hits as (select doc_id, item_id, k, i from grams join win using (k, g)),
places as (select doc_id, count(distinct i + j) as n_hit from (select distinct doc_id, k, i from hits) as h, unnest(range(0, k)) as t(j) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""


@query
def op11_sharding(spark, folder):
    """A shard and a slot in it for every document: equal texts together, near equal bytes."""
    return sharding.digest(sharding.assign(table(spark, folder, "documents")))


@query
def op12_conversation_repair(spark, folder):
    """Faults of every conversation, its turns damaged by checksum, and its cheapest repair."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, folder, "conversations")))


@query
def op13_periodic_runs(spark, folder):
    """Periodic runs of words in every document, a tenth of them with a planted period, and the texts without repetition."""
    return periodic_runs.digest(periodic_runs.detect(table(spark, folder, "documents"), change=periodic_runs.with_period))
