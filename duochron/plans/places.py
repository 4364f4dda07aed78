"""Queries on coordinates, anchors, backgrounds and motifs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.counts import TOP_FEATURES_B
from ..operators import intervals as iv, motifs as mo, stats
from ..session import checkpoint_folder, materialize
from ..sources import readers, twobit
from . import tables as T
from .catalog import query

r6 = S.r6


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


_TOKEN = "CASE WHEN upper(regexp_replace(chrom, '^chr', '')) IN ('X', 'Y') THEN upper(regexp_replace(chrom, '^chr', '')) WHEN try_cast(regexp_replace(chrom, '^chr', '') AS INT) BETWEEN 1 AND 19 THEN regexp_replace(chrom, '^chr', '') END"
_CODE = f"CASE {_TOKEN} WHEN 'X' THEN 20 WHEN 'Y' THEN 21 ELSE CAST({_TOKEN} AS BIGINT) END"
_BINS = f"""{T.INTERVALS}, binned AS (SELECT *, {_CODE} * 100000 + ((start + "end") // 2) // 10000 AS bin FROM intervals)"""


@query("fixed_bins", f"""WITH {_BINS} SELECT l_orderkey, l_linenumber, bin, CASE bin // 100000 WHEN 20 THEN 'chrX' WHEN 21 THEN 'chrY' ELSE 'chr' || (bin // 100000) END AS bin_chrom, bin % 100000 * 10000 AS bin_start, bin % 100000 * 10000 + 10000 AS bin_end FROM binned""")
def fixed_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = iv.binned(T.intervals(spark, sf), "chrom", "start", "end")
    d = S.decode_bin(F.col("bin"))
    return b.select("l_orderkey", "l_linenumber", "bin", d["chrom"].alias("bin_chrom"), d["start"].alias("bin_start"), d["end"].alias("bin_end"))


@query("chromosome_normalise", f"""WITH {T.INTERVALS}, n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN substr(chrom, 4) ELSE chrom END AS chrom FROM intervals)
SELECT l_orderkey, l_linenumber, CASE WHEN chrom LIKE 'chr%' THEN chrom ELSE 'chr' || chrom END AS name, {_TOKEN} AS token, coalesce({_CODE}, 10000) AS sort_order FROM n""")
def chromosome_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.substring("chrom", 4, 10)).otherwise(F.col("chrom"))
    return T.intervals(spark, sf).select(
        "l_orderkey", "l_linenumber", S.normalize_chromosome(raw).alias("name"), S.chromosome_token(raw).alias("token"), S.chromosome_order(raw).alias("sort_order")
    )


@query("bin_presence", f"WITH {_BINS} SELECT DISTINCT l_orderkey AS entity, bin AS feature FROM binned WHERE bin IS NOT NULL")
def bin_presence(spark: SparkSession, sf: str) -> DataFrame:
    return iv.bin_presence(iv.binned(T.intervals(spark, sf), "chrom", "start", "end"), "l_orderkey")


@query("bin_support_topk", f"WITH {_BINS}, p AS (SELECT DISTINCT l_orderkey, bin FROM binned WHERE bin IS NOT NULL) SELECT bin AS feature, count(*) AS n FROM p GROUP BY bin ORDER BY n DESC, bin LIMIT {TOP_FEATURES_B}")
def bin_support_topk(spark: SparkSession, sf: str) -> DataFrame:
    p = iv.bin_presence(iv.binned(T.intervals(spark, sf), "chrom", "start", "end"), "l_orderkey")
    return p.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "feature").limit(TOP_FEATURES_B)


@query("edge_and_width_bins", f"""WITH {T.SEQUENCES}, g AS (SELECT doc_id, n_chars, length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0) AS gc FROM sequences)
SELECT doc_id, round(gc, 6) AS gc, (gc >= 0.35)::INT + (gc >= 0.45)::INT + (gc >= 0.55)::INT + (gc >= 0.65)::INT AS gc_bin, CAST(floor(gc / 0.05) AS INT) AS width_bin FROM g""")
def edge_and_width_bins(spark: SparkSession, sf: str) -> DataFrame:
    g = T.sequences(spark, sf).select("doc_id", S.gc_fraction(F.col("seq")).alias("gc"))
    return g.select("doc_id", r6(F.col("gc")).alias("gc"), S.edge_bin(F.col("gc"), iv.GC_INNER_EDGES).alias("gc_bin"), S.width_bin(F.col("gc"), iv.ACCESS_BIN_WIDTH).alias("width_bin"))


# --------------------------------------------------------------------- anchors
_NEAR = f"""{T.INTERVALS}, {T.ANCHORS}, q AS (SELECT *, (start + "end") // 2 AS position FROM intervals),
ua AS (SELECT chrom, position, arg_min(symbol, anchor_id) AS symbol, min(anchor_id) AS anchor_id FROM anchors GROUP BY ALL),
lo AS (SELECT q.l_orderkey, q.l_linenumber, q.l_quantity AS q, q.chrom, q.position, a.position AS pp FROM q ASOF LEFT JOIN ua a ON q.chrom = a.chrom AND q.position >= a.position),
hi AS (SELECT lo.*, a.position AS np FROM lo ASOF LEFT JOIN ua a ON lo.chrom = a.chrom AND lo.position <= a.position),
pk AS (SELECT l_orderkey, l_linenumber, q, chrom, position, CASE WHEN pp IS NULL OR np - position < position - pp THEN np ELSE pp END AS ap FROM hi),
near AS (SELECT pk.*, ua.anchor_id, ua.symbol, pk.position - ap AS sd FROM pk LEFT JOIN ua ON ua.chrom = pk.chrom AND ua.position = ap)"""
_CLASS = "CASE WHEN sd IS NULL THEN 'no_reference_chromosome' WHEN abs(sd) <= 2000 THEN 'promoter_2kb' WHEN abs(sd) <= 10000 THEN 'proximal_10kb' WHEN abs(sd) <= 50000 THEN 'proximal_50kb' ELSE 'distal_gt50kb' END"


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    q = T.intervals(spark, sf).withColumn("position", F.floor((F.col("start") + F.col("end")) / 2).cast("bigint"))
    return iv.nearest(q, T.anchors(spark, sf), "chrom", "position", ["anchor_id", "symbol"], ["anchor_id"])


@query("nearest_anchor", f"WITH {_NEAR} SELECT l_orderkey, l_linenumber, position, ap AS anchor_position, anchor_id, symbol, sd AS signed_distance, abs(sd) AS distance, {_CLASS} AS distance_class FROM near")
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select("l_orderkey", "l_linenumber", "position", "anchor_position", "anchor_id", "symbol", "signed_distance", "distance", "distance_class")


@query("distance_classes", f"WITH {_NEAR} SELECT {_CLASS} AS distance_class, count(*) AS n FROM near GROUP BY 1")
def distance_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).groupBy("distance_class").agg(F.count(F.lit(1)).alias("n"))


@query("start_site_by_strand", f"WITH {T.ANCHORS} SELECT anchor_id, CASE WHEN strand = '+' THEN position ELSE position + 500 - 1 END AS tss FROM anchors")
def start_site_by_strand(spark: SparkSession, sf: str) -> DataFrame:
    a = T.anchors(spark, sf).withColumn("stop", F.col("position") + 500)
    return readers.with_start_site(a, "position", "stop").select("anchor_id", "tss")


@query("resolve_symbols", """WITH g AS (SELECT 'T' || (p_partkey // 2) AS transcript_id, p_name AS gene_symbol, p_partkey AS line FROM part WHERE p_partkey % 3 > 0),
a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN (SELECT min(p_name) FROM part) ELSE 'T' || (l_partkey // 2) END AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(m.s, a.name) AS symbol, CASE WHEN m.s IS NOT NULL THEN 'transcript_map' WHEN a.name IN (SELECT gene_symbol FROM g) THEN 'name_is_symbol' ELSE 'unresolved' END AS symbol_source
FROM a LEFT JOIN (SELECT transcript_id, arg_max(gene_symbol, line) AS s FROM g GROUP BY 1) m ON m.transcript_id = a.name""")
def resolve_symbols(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part")
    g = p.where("p_partkey % 3 > 0").select(F.concat(F.lit("T"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("transcript_id"), F.col("p_name").alias("gene_symbol"), F.col("p_partkey").alias("line"))
    first = p.agg(F.min("p_name").alias("first"))
    l = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").crossJoin(F.broadcast(first))  # one row
    a = l.withColumn("name", F.when(F.col("l_linenumber") == 1, F.col("first")).otherwise(F.concat(F.lit("T"), F.floor(F.col("l_partkey") / 2).cast("string"))))
    return iv.resolve_symbols(a, "name", g).select("l_orderkey", "l_linenumber", "symbol", "symbol_source")


_CROSS = f"""{_NEAR}, cand AS (SELECT * FROM near WHERE q >= 25 AND abs(sd) <= 50000),
summ AS (SELECT symbol, count(*) AS n_intervals, max(q) AS max_gain, max(q / 50) AS max_fraction, min(abs(sd)) AS min_distance FROM cand WHERE symbol IS NOT NULL GROUP BY symbol)"""


@query("cross_modal_candidates", f"WITH {_CROSS}, g AS (SELECT 'G' || (c_custkey % 500) AS symbol, max(c_acctbal) AS score FROM customer GROUP BY 1 HAVING max(c_acctbal) > 5000) SELECT symbol, round(score, 6) AS score, n_intervals, max_gain, round(max_fraction, 6) AS max_fraction, min_distance FROM g JOIN summ USING (symbol)")
def cross_modal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = _nearest(spark, sf).where("l_quantity >= 25 AND distance <= 50000").withColumn("fraction", F.col("l_quantity") / 50)
    s = iv.symbol_summary(c, "symbol", "l_quantity", "fraction")
    g = T.table(spark, sf, "customer").groupBy(F.concat(F.lit("G"), (F.col("c_custkey") % 500).cast("string")).alias("symbol")).agg(F.max("c_acctbal").alias("score")).where("score > 5000")
    return _round(g.join(s, "symbol"), "score", "max_fraction")


# ------------------------------------------------------------------ backgrounds
_BG = f"""{T.SEQUENCES}, g AS (SELECT doc_id, lang, n_chars, length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0) AS gc, ('0x' || substr(md5('785:' || doc_id), 1, 15))::BIGINT AS ph, ('0x' || substr(md5('786:' || doc_id), 1, 15))::BIGINT AS h FROM sequences),
s AS (SELECT doc_id, lang, gc, h, ph, (n_chars >= 1000)::INT + (n_chars >= 4000)::INT AS size_bin, (gc >= 0.35)::INT + (gc >= 0.45)::INT + (gc >= 0.55)::INT + (gc >= 0.65)::INT AS gc_bin, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS cand FROM g),
ask AS (SELECT lang, size_bin, count(*) * 40 AS n FROM s WHERE cand GROUP BY ALL),
pool AS (SELECT p.* FROM (SELECT *, row_number() OVER (PARTITION BY lang, size_bin ORDER BY ph, doc_id) AS pr FROM s WHERE NOT cand) p JOIN ask USING (lang, size_bin) WHERE pr <= n),
want AS (SELECT lang, size_bin, gc_bin, count(*) AS c, count(*) * 10 AS n FROM s WHERE cand GROUP BY ALL),
bg AS (SELECT *, row_number() OVER (PARTITION BY lang, size_bin, gc_bin ORDER BY h, doc_id) AS r FROM pool),
chosen AS (SELECT bg.* FROM bg JOIN want USING (lang, size_bin, gc_bin) WHERE r <= n)"""


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = T.table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("_t", F.lit(True))
    d = T.sequences(spark, sf).select("doc_id", "lang", S.edge_bin(F.col("n_chars"), [1000, 4000]).alias("size_bin"), S.gc_fraction(F.col("seq")).alias("gc")).join(t, "doc_id", "left")
    d = materialize(d.withColumn("gc_bin", S.edge_bin(F.col("gc"), iv.GC_INNER_EDGES)))  # texts are read once
    cand, bg = d.where("_t"), d.where("_t IS NULL")
    h = lambda seed: S.hash60(seed, F.col("doc_id"))
    chosen, audit = iv.match_in_two_stages(bg, cand, ["lang", "size_bin"], ["gc_bin"], h(785), h(786), "doc_id")
    return cand, chosen, audit


@query("matched_background", f"WITH {_BG} SELECT doc_id, lang, size_bin, gc_bin, round(gc, 6) AS gc FROM chosen")
def matched_background(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_matched(spark, sf)[1].select("doc_id", "lang", "size_bin", "gc_bin", "gc"), "gc")


@query("background_audit", f"WITH {_BG}, av AS (SELECT lang, size_bin, gc_bin, count(*) AS a FROM bg GROUP BY ALL) SELECT lang, size_bin, gc_bin, c AS candidate_n, n AS requested, coalesce(a, 0) AS available, least(n, coalesce(a, 0)) AS selected FROM want LEFT JOIN av USING (lang, size_bin, gc_bin)")
def background_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)[2]


@query("background_smd", f"""WITH {_BG}, u AS (SELECT gc, true AS c FROM s WHERE cand UNION ALL SELECT gc, false FROM chosen)
SELECT count(*) FILTER (c) AS n_candidates, count(*) FILTER (NOT c) AS n_background, round((avg(gc) FILTER (c) - avg(gc) FILTER (NOT c)) / sqrt((var_samp(gc) FILTER (c) + var_samp(gc) FILTER (NOT c)) / 2), 6) AS smd_gc FROM u""")
def background_smd(spark: SparkSession, sf: str) -> DataFrame:
    cand, chosen, _ = _matched(spark, sf)
    u = cand.select("gc", F.lit(True).alias("c")).unionByName(chosen.select("gc", F.lit(False).alias("c")))
    return u.agg(F.count_if(F.col("c")).alias("n_candidates"), F.count_if(~F.col("c")).alias("n_background"), r6(stats.smd(F.col("c"), F.col("gc"))).alias("smd_gc"))


# ----------------------------------------------------------------------- motifs
def _motifs(spark: SparkSession, sf: str) -> DataFrame:
    """One matrix per benchmark item, 7 to 11 columns wide by its id: how often each of A, C, G and T
    stands at the places of the whole text's letters that fall on a column. An item with fewer letters has
    empty columns, which weigh nothing."""
    letters = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    base = T.table(spark, sf, "benchmark").select(F.format_string("M%04d", "item_id").alias("motif_id"), (F.lit(7) + F.col("item_id") % 5).cast("int").alias("w"), letters.alias("letters"))
    placed = base.where("letters <> ''").select("motif_id", "w", F.posexplode(F.split("letters", "")).alias("p", "c")).where("c <> ''")
    counts = placed.groupBy("motif_id", (F.col("p") % F.col("w")).alias("j")).agg(*[F.count_if(F.col("c") == b).alias(b) for b in "ACGT"])
    slots = base.select("motif_id", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("j")).join(counts, ["motif_id", "j"], "left")
    cols = slots.groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("j", *[F.coalesce(F.col(b), F.lit(0)).cast("double").alias(b) for b in "ACGT"]))).alias("c"))
    row = lambda b: F.transform("c", lambda x: x[b])
    return cols.select("motif_id", F.array(*[row(b) for b in "ACGT"]).alias("pfm"))


def _motif_sql() -> str:
    """Matrices, weights in units of 0.001, exact thresholds by one column after the other, and hits."""
    unit = lambda b: f"CAST(round(ln((count(*) FILTER (l = '{b}') + 0.2) / (count(l) + 0.8) / 0.25) / 0.001) AS BIGINT)"
    steps = "".join(
        f", d{j + 1} AS (SELECT d.motif_id, d.s + coalesce(c.u, 0) AS s, sum(d.n * CASE WHEN c.u IS NULL THEN 1.0 ELSE 0.25 END) AS n FROM d{j} d LEFT JOIN cell c ON c.motif_id = d.motif_id AND c.j = {j} GROUP BY ALL)" for j in range(11)
    )
    score = lambda w: f"list_sum([m.u[(i - 1) * 4 + strpos('ACGT', {w}[i])] for i in range(1, m.w + 1)])"
    return f"""item AS (SELECT printf('M%04d', item_id) AS motif_id, 7 + item_id % 5 AS w, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS t FROM benchmark),
slot AS (SELECT motif_id, w, t, unnest(range(0, w)) AS j FROM item), lett AS (SELECT motif_id, j, unnest([t[i] for i in range(j + 1, len(t) + 1, w)]) AS l FROM slot),
col AS (SELECT s.motif_id, s.j, s.w, {unit('A')} AS a, {unit('C')} AS c, {unit('G')} AS g, {unit('T')} AS t FROM slot s LEFT JOIN lett x ON x.motif_id = s.motif_id AND x.j = s.j GROUP BY s.motif_id, s.j, s.w),
cell AS (SELECT motif_id, j, unnest([a, c, g, t]) AS u FROM col), d0 AS (SELECT motif_id, 0::BIGINT AS s, 1.0::DOUBLE AS n FROM item){steps},
tail AS (SELECT motif_id, s, sum(n) OVER (PARTITION BY motif_id ORDER BY s DESC) AS q FROM d11), cut AS (SELECT motif_id, min(s) AS cut FROM tail WHERE q <= 1e-4 GROUP BY motif_id),
mot AS (SELECT motif_id, any_value(w) AS w, flatten(list([a, c, g, t] ORDER BY j)) AS u FROM col GROUP BY motif_id),
kmer AS (SELECT doc_id, w, substr(seq, i, w) AS k FROM sequences, (SELECT unnest(range(7, 12)) AS w), LATERAL (SELECT unnest(range(1, length(seq) - w + 2)) AS i) WHERE length(seq) >= w),
kc AS (SELECT doc_id, w, k, count(*) AS n FROM kmer GROUP BY ALL), dk AS (SELECT DISTINCT w, k, reverse(translate(k, 'ACGT', 'TGCA')) AS r FROM kc),
good AS (SELECT m.motif_id, dk.w, dk.k, {score('dk.k')} >= cut AS f, {score('dk.r')} >= cut AS r FROM dk JOIN mot m ON m.w = dk.w JOIN cut USING (motif_id)),
hit AS (SELECT doc_id, motif_id, sum(n) FILTER (f) AS f, sum(n) FILTER (r) AS r FROM kc JOIN (SELECT * FROM good WHERE f OR r) USING (w, k) GROUP BY ALL)"""


_MOTIFS = _motif_sql()


@query("motif_presence", f"WITH {T.SEQUENCES}, {_MOTIFS} SELECT doc_id, motif_id, coalesce(f, 0)::BIGINT AS forward_hits, coalesce(r, 0)::BIGINT AS reverse_hits, (coalesce(f, 0) + coalesce(r, 0))::BIGINT AS total_hits FROM hit")
def motif_presence(spark: SparkSession, sf: str) -> DataFrame:
    return mo.scan(T.sequences(spark, sf), "doc_id", "seq", _motifs(spark, sf))


_FISHER = f"""{T.SEQUENCES}, {_MOTIFS}, tested AS (SELECT doc_id, max(quality) = 1 AS c FROM labels GROUP BY doc_id), tot AS (SELECT count(*) FILTER (c) AS cn, count(*) FILTER (NOT c) AS bn FROM tested),
h AS (SELECT motif_id, count(*) FILTER (c) AS a, count(*) FILTER (NOT c) AS b FROM hit JOIN tested USING (doc_id) GROUP BY motif_id),
tb AS (SELECT motif_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, cn, bn FROM mot LEFT JOIN h USING (motif_id), tot),
fp AS (SELECT *, (SELECT sum(exp(lgamma(cn + 1) - lgamma(k + 1) - lgamma(cn - k + 1) + lgamma(bn + 1) - lgamma(a + b - k + 1) - lgamma(bn - a - b + k + 1) - lgamma(cn + bn + 1) + lgamma(a + b + 1) + lgamma(cn + bn - a - b + 1)))
   FROM (SELECT unnest(range(greatest(a, a + b - bn), least(cn, a + b) + 1)) AS k)) AS p FROM tb),
o AS (SELECT *, least(p, 1.0) AS pv, row_number() OVER (ORDER BY round(least(p, 1.0), 12), motif_id) AS rk, count(*) OVER () AS m FROM fp),
bh AS (SELECT *, least(1.0, min(pv * m / rk) OVER (ORDER BY rk DESC)) AS fdr, CASE WHEN b * (cn - a) > 0 THEN a * (bn - b) / (b * (cn - a))::DOUBLE WHEN a * (bn - b) > 0 THEN 'inf'::DOUBLE END AS orr FROM o)"""


def _enrichment(spark: SparkSession, sf: str) -> DataFrame:
    flagged = T.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    m = materialize(_motifs(spark, sf))
    hits = materialize(mo.scan(T.sequences(spark, sf), "doc_id", "seq", m))
    return mo.enrichment(hits, "doc_id", flagged, F.col("q") == 1, m)


@query("fisher_bh", f"WITH {_FISHER} SELECT motif_id, a AS candidate_hits, cn AS candidate_n, b AS background_hits, bn AS background_n, round(orr, 6) AS odds_ratio, round(pv, 6) AS fisher_p, round(fdr, 6) AS fdr, coalesce(fdr <= 0.05 AND orr >= 1.5 AND a >= 5, false) AS enriched FROM bh")
def fisher_bh(spark: SparkSession, sf: str) -> DataFrame:
    e = _enrichment(spark, sf).drop("candidate_fraction", "background_fraction")
    return _round(e, "odds_ratio", "fisher_p", "fdr")


@query("motif_diagnostics", f"WITH {_FISHER} SELECT motif_id, round(-log10(greatest(pv, 1e-300)), 6) + 0 AS neg_log10_p, round(-log10(greatest(fdr, 1e-300)), 6) + 0 AS neg_log10_fdr, fdr <= 0.05 AS passes_fdr, orr >= 1.5 AS passes_odds, a >= 5 AS passes_hits FROM bh")
def motif_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = mo.diagnostics(_enrichment(spark, sf))
    return _round(d.select("motif_id", "neg_log10_p", "neg_log10_fdr", "passes_fdr", "passes_odds", "passes_hits"), "neg_log10_p", "neg_log10_fdr")


@query("motif_universe", """WITH mot AS (SELECT printf('M%04d', p_partkey) AS motif_id, CASE WHEN p_partkey % 10 = 0 THEN p_name || '::X' ELSE p_name END AS tf_name FROM part),
g AS (SELECT upper(trim(p_name)) AS s, min(p_name) AS feature, round(avg(l_quantity), 6) AS pre_cpm, count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders) AS pre_fraction FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT motif_id, tf_name, tf_name NOT LIKE '%::%' AS single_factor, feature IS NOT NULL AS mapped, coalesce(pre_cpm >= 2 AND pre_fraction >= 0.02, false) AS expressed, s LIKE 'RED%' AS is_later_candidate,
  tf_name NOT LIKE '%::%' AND feature IS NOT NULL AND coalesce(pre_cpm >= 2 AND pre_fraction >= 0.02, false) AS eligible FROM (SELECT m.*, g.feature, g.pre_cpm, g.pre_fraction, upper(trim(tf_name)) AS s FROM mot m LEFT JOIN g ON g.s = upper(trim(tf_name)))""")
def motif_universe(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part")
    m = p.select(F.format_string("M%04d", "p_partkey").alias("motif_id"), F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("::X"))).otherwise(F.col("p_name")).alias("tf_name"))
    n = T.table(spark, sf, "orders").count()
    names = p.select("p_partkey", F.upper(F.trim("p_name")).alias("s"), F.col("p_name").alias("feature"))
    e = T.table(spark, sf, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey")).groupBy("s").agg(
        F.min("feature").alias("feature"), r6(F.avg("l_quantity")).alias("pre_cpm"), (F.count_distinct("l_orderkey") / F.lit(n)).alias("pre_fraction")
    ).drop("s")
    later = m.where(F.upper(F.trim("tf_name")).startswith("RED")).select(F.col("tf_name").alias("feature"))
    u = mo.universe(m, e, "feature", ["pre_cpm"], ["pre_fraction"], later, m.limit(0).select(F.col("tf_name").alias("feature")))
    return u.select("motif_id", "tf_name", "single_factor", "mapped", "expressed", "is_later_candidate", "eligible")


# four intervals a text: three inside, one past its end; texts of any length, and one unknown sequence
@query("extract_sequences", f"""WITH {T.SEQUENCES}, iv AS (SELECT doc_id, length(seq) // 5 * k AS s, least(length(seq), length(seq) // 5 * k + 120) + CASE WHEN k = 4 THEN 120 ELSE 0 END AS e, length(seq) AS n, seq FROM sequences, LATERAL (SELECT unnest([0, 1, 3, 4]) AS k)),
all_iv AS (SELECT * FROM iv UNION ALL SELECT -1 - doc_id, 0, 50, NULL, NULL FROM documents)
SELECT doc_id, s AS start, e AS "end", CASE WHEN n IS NOT NULL AND e > s AND e <= n THEN substr(seq, s + 1, e - s) END AS sequence, n IS NOT NULL AND e > s AND e <= n AS complete,
  CASE WHEN n IS NULL THEN 'unknown_sequence' WHEN e <= s OR e > n THEN 'out_of_range' END AS issue FROM all_iv""")
def extract_sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sequences(spark, sf).select("doc_id", "seq")
    n, k = F.length("seq").cast("bigint"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(4)))
    i = s.select("doc_id", n.alias("n"), k.alias("k")).select("doc_id", (F.floor(F.col("n") / 5) * F.col("k")).alias("start"), "n", "k")
    i = i.select("doc_id", "start", (F.least("n", F.col("start") + 120) + F.when(F.col("k") == 4, 120).otherwise(0)).alias("end"))
    unknown = T.table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).cast("bigint").alias("start"), F.lit(50).cast("bigint").alias("end"))
    return readers.extract_sequences(i.unionByName(unknown), s, "doc_id", tile=128)


_PACKED_TILE = 1024


# whole texts as sequences: any other letter is unknown, lower case stays masked
@query("packed_sequences", f"""WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ACGTacgt]', 'N', 'g') AS seq FROM documents),
t AS (SELECT doc_id, length(seq) AS size, unnest(range(0, greatest(1, (length(seq) + {_PACKED_TILE - 1}) // {_PACKED_TILE}))) AS tile, seq FROM s),
p AS (SELECT doc_id, size, tile, substr(seq, tile * {_PACKED_TILE} + 1, {_PACKED_TILE}) AS part FROM t)
SELECT CAST(doc_id AS VARCHAR) AS chrom, size, tile, tile * {_PACKED_TILE} AS start, length(part) AS letters, length(regexp_replace(part, '[^N]', '', 'g')) AS unknown, length(regexp_replace(part, '[^a-z]', '', 'g')) AS masked, sha256(part) AS part_sha256 FROM p""")
def packed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Written as packed files to the shared folder and read back by tiles."""
    s = T.table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", "N").alias("seq"))
    to = f"{checkpoint_folder(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    twobit.write_two_bit(s, to, "doc_id")
    t = twobit.read_two_bit(spark, to, tile=_PACKED_TILE)
    count = lambda letters: F.length(F.regexp_replace("part", f"[^{letters}]", ""))
    return t.select("chrom", "size", "tile", "start", F.length("part").alias("letters"), count("N").alias("unknown"), count("a-z").alias("masked"), F.sha2("part", 256).alias("part_sha256"))
