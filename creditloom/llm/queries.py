"""The contract's queries over the operators of this subpackage, each on its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import (
    decontaminate,
    dialogue_repair,
    exact_dedup,
    html_tree,
    license_scan,
    minhash,
    nearest,
    pieces,
    quality,
    resampling,
    sharding,
    token_counts,
    url_filter,
)
from creditloom.session import UNION_BY_KEY, configure

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
SHARDS = 24
GOOD = 0.3

# Python workers take rows in batches; with texts of up to some MB a batch stays within a few hundred MB.
ARROW_ROWS = "1000"


@dataclass(frozen=True)
class LlmQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


LLM_QUERIES: dict[str, LlmQuery] = {}


def query(sql: str | None = None):
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepared(spark), sf_dir)

        LLM_QUERIES[build.__name__] = LlmQuery(run, sql)
        return build

    return add


def prepared(spark: SparkSession) -> SparkSession:
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set(UNION_BY_KEY, "true")  # unions here are of the same key and grouped by it next
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


@query()
def op1_jump_hash_shards(spark, sf_dir):
    """Every document's shard by jump consistent hashing of its id."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


_RULES_SQL = ", ".join(f"('{t}', '{a}')" for t, a in url_filter.BASE_RULES)
_PATTERNS_SQL = ", ".join(
    "('{}', '{}')".format(url_filter.Rule(t, a, False).regex.replace("'", "''"), a) for t, a in url_filter.PATTERN_RULES
)
OP2_SQL = rf"""
with split as (
  select page_id, url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*((?s:.*))', 1) as tail,
    row_number() over () as rn from split),
rules(rule, action) as (values {_RULES_SQL}),
patterns(regex, action) as (values {_PATTERNS_SQL}),
fits as (
  select rn, rule, action from parts, rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
    and starts_with(path, substr(rule, position('/' in rule)))),
best as (select rn, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from fits group by rn),
hits as (select rn from parts, patterns where regexp_matches(host || path || tail, regex) group by rn)
select page_id, host, path, rule, case when action is not null then action when hits.rn is not null then 'block' else 'allow' end as verdict
from parts left join best using (rn) left join hits using (rn)
"""


@query(OP2_SQL)
def op2_url_filter(spark, sf_dir):
    """Verdict on every page's URL."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query()
def op3_quality_classifier(spark, sf_dir):
    """Quality score of every whole document, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.remainder("doc_id") == 0, F.lit(False))
    return quality.score_documents(docs, network).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


@query()
def op4_license_scan(spark, sf_dir):
    """License phrases and fuzzy short notices in every whole document."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score"
    )


@query()
def op5_site_style_tree(spark, sf_dir):
    """Main text of every page."""
    return html_tree.main_text(table(spark, sf_dir, "pages"))


OP6_SQL = rf"""
with recursive toks as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from toks),
texts as (select min(doc_id) as rep, s, len(s) as n from (select doc_id, list_sort(s) as s from sets) group by s),
members as (select a.doc_id, b.rep, b.n from sets a join texts b on list_sort(a.s) = b.s),
post as (select rep, n, unnest(s) as g from texts),
pairs as (
  select a.rep as x, b.rep as y from post a join post b on a.g = b.g and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links as (select x, y from pairs union all select y, x from pairs),
reach(x, y) as (select rep, rep from texts union select reach.x, links.y from reach join links on reach.y = links.x),
comp as (select x as rep, min(y) as c from reach group by x)
select m.doc_id, m.n::bigint as n_shingles, case when m.n = 0 then m.doc_id else c.c end as component_id,
  m.doc_id = (case when m.n = 0 then m.doc_id else c.c end) as kept
from members m join comp c on m.rep = c.rep
"""


@query(OP6_SQL)
def op6_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op7_token_counts(spark, sf_dir):
    """Word-piece token counts of every whole document."""
    found = token_counts.load_pieces(vocabulary_file("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), found)


@query()
def op8_nearest_neighbours(spark, sf_dir):
    """The 20 nearest rows of every query row."""
    return nearest.search(table(spark, sf_dir, "embeddings"))


@query()
def op9_piece_codec(spark, sf_dir):
    """Piece ids of every whole document, and whether they decode to the same text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.col("text").alias("original"))
    vocabulary = pieces.load_vocabulary(vocabulary_file("piece_bpe_32k.model"))
    back = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    same = F.col("text").eqNullSafe(F.col("original"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


@query()
def op10_decontamination(spark, sf_dir):
    """Every place where a document repeats a benchmark item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC = """
crc_bits(t) as (select list_transform(range(256), lambda v: list_reduce(range(8), lambda a, b:
    case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, v)))"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte through the usual table (column t of crc_bits)."""
    hexed = f"hex(encode({text}))"
    codes = f"list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::bigint)"
    step = "xor(a >> 8, t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, lambda a, b: {step}, 4294967295), 4294967295)"


OP11_SQL = rf"""
with {_CRC},
rows as (select doc_id, text, false as wanted from documents union all select null, text, true from benchmark),
words as (
  select row_number() over () as rn, doc_id, wanted,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from rows),
grams as (
  select rn, wanted, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from words),
sums as (select g, {_crc_sql("g")} % 10000 as b from (select distinct g from grams), crc_bits),
hits as (select rn, wanted, b from grams join sums using (g)),
counts as (select b, count(*) filter (not wanted) as s, count(*) filter (wanted) as t from hits group by b),
totals as (select sum(s)::double as s, sum(t)::double as t from counts),
gain as (
  select b, floor(1000e0 * ln(((counts.t + 1)::double * (totals.s + 10000e0))
    / ((counts.s + 1)::double * (totals.t + 10000e0))))::bigint as gain from counts, totals),
weights as (
  select rn, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
  from hits join gain using (b) where not wanted group by rn),
scored as (
  select words.doc_id, len(words.w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000e0 * ln(-ln((('0x' || substr(sha256('7:' || words.doc_id), 1, 8))::bigint + 5e-1) / 4294967296e0)))::bigint as score
  from words left join weights using (rn) where not words.wanted),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_words >= 20)
select scored.doc_id, n_features, weight, score, case when 100 * rank <= 25 * n - (25 * n) % 100 then rank end as rank
from scored left join ranked using (doc_id)
"""


@query(OP11_SQL)
def op11_importance_resampling(spark, sf_dir):
    """Weight, score and rank of every document, drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with bare as (
  select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents),
best as (
  select text_sha256, count(*) as group_size, arg_min(doc_id, (-points, doc_id)) as keep_id from bare group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from bare join best using (text_sha256)
"""


@query(OP12_SQL)
def op12_exact_dedup(spark, sf_dir):
    """Group and winner of every document; every second one, by a hash of its id, counts as history."""
    historical = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), historical)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _consumed(state: int) -> str:
    """Cheapest, then ASCII-least way to work off row m in a state without an insertion; b holds the ways of the rows behind it."""

    def way(cost: str, letter: str, line: str | None, to: int) -> str:
        lines = f"list_prepend({line}, b.s{to}.t)" if line else f"b.s{to}.t"
        return "{'c': b.s%d.c + %s, 'a': '%s' || b.s%d.a, 't': %s}" % (to, cost, letter, to, lines)

    options = [f"[{way('3', 'D', None, state)}]"]
    for kind, initial in enumerate("sua"):
        to = dialogue_repair.KEPT[kind][state]
        if to is not None:
            options.append(f"case when m.i = '{initial}' and m.f < 2 then [{way('m.f', 'K', 'm.line', to)}] else [] end")
            if kind:
                line = f"'{dialogue_repair.ROLE[to]}:' || m.text"
                options.append(f"case when m.f < 2 then [{way('2 + m.f', 'R', line, to)}] else [] end")
    return f"list_sort(flatten([{', '.join(options)}]))[1]"


def _inserted(state: int) -> str:
    """The better of going on in a state and of one or two insertions first."""
    one = dialogue_repair.INSERTED[state]
    two = dialogue_repair.INSERTED[one]
    first, second = (f"'{dialogue_repair.ROLE[x]}:'" for x in (one, two))
    once = "{'c': c%d.c + 2, 'a': 'I' || c%d.a, 't': list_prepend(%s, c%d.t)}" % (one, one, first, one)
    twice = "{'c': c%d.c + 4, 'a': 'II' || c%d.a, 't': list_prepend(%s, list_prepend(%s, c%d.t))}" % (two, two, first, second, two)
    return f"list_sort([c{state}, {once}, {twice}])[1]"


OP13_SQL = rf"""
with recursive {_CRC},
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
keyed as (select raw.*, {_crc_sql("k")} % 20 as fate from raw, crc_bits),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fate = 3 then 2 else 1 end)) as copy from keyed where fate <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as rn,
    count(*) over (partition by conv_id) as n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by rn) as nth from placed),
marked as (
  select *, substr(role, 1, 1) as i, role || ':' || text as line, lag(substr(role, 1, 1)) over (partition by conv_id order by rn) as h,
    case when bare = '' then 2 when nth > 1 then 3 when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end as f from seen),
best(conv_id, k, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}},
    {{'c': 4::bigint, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 2::bigint, 'a': 'I', 't': ['assistant:']}},
    {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} from (select distinct conv_id from marked)
  union all
  select conv_id, k, {", ".join(_inserted(q) for q in range(4))} from (
    select b.conv_id, b.k + 1 as k, {", ".join(f"{_consumed(q)} as c{q}" for q in range(4))}
    from best b join marked m on m.conv_id is not distinct from b.conv_id and m.rn = m.n - b.k)),
figures as (
  select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = 2) as blank,
    count(*) filter (where f = 3) as duplicate, count(*) filter (where f = 1) as truncated,
    count(*) filter (where h is not null and h || i not in ('su', 'ua', 'au')) as illegal from marked group by conv_id),
done as (
  select g.*, s0.c as cost, s0.a as audit, sha256(array_to_string(s0.t, chr(10))) as hash
  from figures g join best b on b.conv_id is not distinct from g.conv_id and b.k = g.n)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, coalesce(hash, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join done d on d.conv_id is not distinct from o.conv_id
"""


@query(OP13_SQL)
def op13_dialogue_repair(spark, sf_dir):
    """Cheapest repair of every conversation after planted damage."""
    damaged = dialogue_repair.damage(table(spark, sf_dir, "conversations"))
    return dialogue_repair.repair(damaged, dropped=F.col("dropped"))
