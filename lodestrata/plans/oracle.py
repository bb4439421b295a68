"""DuckDB SQL for the queries of the catalogue."""

#: Events with their batch and place.
_E = "WITH e AS (SELECT CAST(row_number() OVER (ORDER BY event_id)-1 AS BIGINT) AS o, CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)"
_PATTERN = "CASE event_type WHEN 'purchase' THEN 'event_id,user_id,value' WHEN 'error' THEN 'event_id,user_id,props' ELSE 'event_id,user_id' END"
#: Orders as their keys' text, and the letters of documents that are bases.
_BASES = "SELECT doc_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents"

ORACLES: dict[str, str] = {
    "batch_assign": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)
SELECT batch_id, count(*) AS n_rec, min(event_id) AS first_id, max(event_id) AS last_id FROM e GROUP BY batch_id
""",
    "segment_stats": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)
SELECT batch_id, 'value' AS field, count(*) AS n_records, count(*)-count(value) AS n_null, min(value) AS min_v, max(value) AS max_v FROM e GROUP BY batch_id
UNION ALL
SELECT batch_id, 'user_id', count(*), count(*)-count(user_id), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM e GROUP BY batch_id
""",
    "segment_overlap": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events),
s AS (SELECT batch_id, min(value) AS mn, max(value) AS mx FROM e GROUP BY batch_id)
SELECT batch_id, (greatest(500.0,400.0) >= mn AND mx >= least(500.0,400.0)) AS overlaps FROM s
""",
    "pruned_range_scan": r"""
SELECT event_id, user_id, event_type, value FROM events WHERE value BETWEEN 400 AND 500
""",
    "dict_encode_scalar": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events),
d AS (SELECT batch_id, event_type, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY min(event_id))-1 AS INTEGER) AS code FROM e GROUP BY batch_id, event_type)
SELECT e.event_id, e.batch_id, d.code FROM e JOIN d USING (batch_id, event_type)
""",
    "dict_values": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)
SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY min(event_id))-1 AS INTEGER) AS code, event_type FROM e GROUP BY batch_id, event_type
""",
    "dict_decision": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)
SELECT batch_id, 'event_type' AS field, count(DISTINCT event_type) AS n_distinct, count(event_type) AS n_valid, count(DISTINCT event_type) < 0.2*count(event_type) AS use_dict FROM e GROUP BY batch_id
UNION ALL
SELECT batch_id, 'event_id', count(DISTINCT event_id), count(event_id), count(DISTINCT event_id) < 0.2*count(event_id) FROM e GROUP BY batch_id
""",
    "dict_contains": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events),
d AS (SELECT DISTINCT batch_id, user_id FROM e)
SELECT batch_id, CAST(count(*) FILTER (WHERE user_id = 7) AS BIGINT) AS matches FROM d GROUP BY batch_id
""",
    "dict_roundtrip": r"""
SELECT event_id, event_type FROM events
""",
    "tensor_dict_encode": r"""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
d AS (SELECT roles, CAST(row_number() OVER (ORDER BY min(conv_id))-1 AS INTEGER) AS code FROM t GROUP BY roles)
SELECT t.conv_id, d.code, array_to_string(t.roles, ',') AS roles FROM t JOIN d ON t.roles = d.roles
""",
    "tensor_contains_any": r"""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len(list_filter(roles, lambda x: x = 'user')) AS INTEGER) AS matches FROM t
""",
    "tensor_contains_exact": r"""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, roles = ['user','assistant'] AS is_match FROM t
""",
    "tensor_offsets": r"""
WITH t AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(sum(n) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS off_start, CAST(sum(n) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS off_end FROM t
""",
    "tensor_explode": r"""
SELECT vec_id, CAST(i-1 AS INTEGER) AS pos, embedding[i] AS element FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding)+1)) AS i FROM embeddings)
""",
    "tensor_stats": r"""
SELECT vec_id, list_min(embedding) AS min_e, list_max(embedding) AS max_e, CAST(len(embedding) AS INTEGER) AS n_elements FROM embeddings
""",
    "column_split": r"""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, roles[1] AS role_0, roles[2] AS role_1, roles[3] AS role_2, roles[4] AS role_3, roles[5] AS role_4, roles[6] AS role_5, roles[7] AS role_6, roles[8] AS role_7 FROM t
""",
    "delta_encode": r"""
WITH o AS (SELECT CAST((row_number() OVER (ORDER BY o_orderkey)-1)//4096 AS INTEGER) AS batch_id, o_orderkey, o_custkey FROM orders),
d AS (SELECT *, o_custkey - lag(o_custkey,1,0) OVER (PARTITION BY batch_id ORDER BY o_orderkey) AS r FROM o)
SELECT o_orderkey, batch_id, CAST(((r % 4294967296) + 4294967296) % 4294967296 AS BIGINT) AS delta FROM d
""",
    "delta_roundtrip": r"""
SELECT o_orderkey, o_custkey AS decoded FROM orders
""",
    "delta_delta": r"""
WITH d AS (SELECT o_orderkey, o_custkey - lag(o_custkey,1,0) OVER (ORDER BY o_orderkey) AS d1 FROM orders)
SELECT o_orderkey, CAST(d1 - lag(d1,1,0) OVER (ORDER BY o_orderkey) AS BIGINT) AS dd FROM d
""",
    "null_pad_union": r"""
SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS INTEGER) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation
UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region
""",
    "schema_patterns": r"""
WITH p AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'event_id,ts,value' WHEN 'error' THEN 'event_id,ts,props' ELSE 'event_id,ts' END AS pattern FROM events)
SELECT pattern, CAST(row_number() OVER (ORDER BY min(event_id))-1 AS INTEGER) AS schema_id, count(*) AS n_rows FROM p GROUP BY pattern
""",
    "schema_filter": r"""
SELECT event_id, value FROM events WHERE event_type = 'purchase'
""",
    "batch_local_fields": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events),
f AS (SELECT batch_id, event_id, 0 AS slot, 'event_id' AS field FROM e UNION ALL SELECT batch_id, event_id, 1, 'ts' FROM e
UNION ALL SELECT batch_id, event_id, 2, 'value' FROM e WHERE event_type='purchase' UNION ALL SELECT batch_id, event_id, 2, 'props' FROM e WHERE event_type='error')
SELECT batch_id, field, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY min(event_id*10+slot))-1 AS INTEGER) AS local_id FROM f GROUP BY batch_id, field
""",
    "field_occurrences": r"""
SELECT 'value' AS field, count(*) FILTER (WHERE event_type='purchase') AS n_valid, count(*) FILTER (WHERE event_type<>'purchase') AS n_null FROM events
UNION ALL SELECT 'props', count(*) FILTER (WHERE event_type='error'), count(*) FILTER (WHERE event_type<>'error') FROM events
""",
    "bloom_semi": r"""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""",
    "bloom_sizing": r"""
WITH n AS (SELECT count(DISTINCT o_custkey) AS ndv FROM orders),
m AS (SELECT ndv, greatest(256, CAST(floor(-8.0*ndv/ln(1-pow(0.05,1.0/8))) AS BIGINT)) AS raw FROM n)
SELECT ndv, CAST(pow(2, ceil(log2(raw))) AS BIGINT) AS num_bits FROM m
""",
    "prune_cascade": r"""
SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error' AND user_id = 13 AND value >= 50
""",
    "md5_checksum": r"""
SELECT doc_id, md5(text) AS digest FROM documents
""",
    "batch_checksum": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)
SELECT batch_id, md5(string_agg(event_type, ',' ORDER BY event_id)) AS digest FROM e GROUP BY batch_id
""",
    "string_split": r"""
SELECT page_id, CAST(len(list_filter(regexp_split_to_array(url, '[:/?&=.]'), lambda x: x <> '')) AS INTEGER) AS n_tokens, array_to_string(list_filter(regexp_split_to_array(url, '[:/?&=.]'), lambda x: x <> ''), '|') AS tokens FROM pages
""",
    "tag_parse": r"""
SELECT event_id, 'UI' AS tag, 'i' AS tag_type, CAST(user_id AS VARCHAR) AS tag_value FROM events
UNION ALL SELECT event_id, 'ET', 'Z', event_type FROM events
""",
    "string_dict": r"""
WITH v AS (SELECT o_orderkey*2 AS ord, o_orderstatus AS s FROM orders UNION ALL SELECT o_orderkey*2+1, o_orderpriority FROM orders)
SELECT s AS token, CAST(row_number() OVER (ORDER BY min(ord))-1 AS INTEGER) AS id FROM v GROUP BY s
""",
    "base_2bit": r"""
WITH b AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents)
SELECT doc_id, CAST(length(seq) AS INTEGER) AS n_bases, translate(seq, 'ACGTN', '01230') AS codes, CAST(length(seq)-length(replace(seq,'N','')) AS INTEGER) AS n_masked FROM b
""",
    "describe_fields": r"""
WITH e AS (SELECT CAST((row_number() OVER (ORDER BY event_id)-1)//4096 AS INTEGER) AS batch_id, * FROM events)
SELECT 'event_id' AS field, 'INT64' AS ptype, 'COLUMN' AS layout, count(*) AS n, count(DISTINCT batch_id) AS n_batches FROM e
UNION ALL SELECT 'value', 'DOUBLE', 'COLUMN', count(value), count(DISTINCT batch_id) FROM e
UNION ALL SELECT 'event_type', 'UINT8', 'TENSOR', count(event_type), count(DISTINCT batch_id) FROM e
""",
    "archive_read": f"""
{_E}, p AS (SELECT *, {_PATTERN} AS pattern FROM e), k AS (SELECT pattern, CAST(row_number() OVER (ORDER BY min(o))-1 AS INTEGER) AS _schema_id FROM p GROUP BY pattern)
SELECT event_id, user_id, event_type, value, _schema_id FROM p JOIN k USING (pattern)
""",
    "archive_batches": f"""
{_E}, f AS (SELECT batch_id, o*10 AS a, 'event_id' AS field FROM e UNION ALL SELECT batch_id, o*10+1, 'user_id' FROM e
UNION ALL SELECT batch_id, o*10+2, 'value' FROM e WHERE event_type='purchase' UNION ALL SELECT batch_id, o*10+2, 'props' FROM e WHERE event_type='error'),
g AS (SELECT batch_id, field, min(a) AS a FROM f GROUP BY batch_id, field), h AS (SELECT batch_id, string_agg(field, ',' ORDER BY a) AS fields FROM g GROUP BY batch_id)
SELECT batch_id, count(*) AS n_rec, min(o) AS first, max(o) AS last, any_value(fields) AS fields FROM e JOIN h USING (batch_id) GROUP BY batch_id
""",
    "archive_fields": """
SELECT * FROM (VALUES (0, 'event_id', 'bigint', 'COLUMN', ''), (1, 'user_id', 'bigint', 'COLUMN', 'DELTA,ZSTD'), (2, 'event_type', 'string', 'TENSOR', ''), (3, 'value', 'double', 'COLUMN', 'ZSTD'), (4, 'props', 'string', 'TENSOR', 'RC_ILLUMINA_NAME')) t(field_id, name, ptype, layout, transforms)
""",
    "archive_schemas": f"""
{_E}, p AS (SELECT o, {_PATTERN} AS pattern FROM e)
SELECT pattern, CAST(row_number() OVER (ORDER BY min(o))-1 AS INTEGER) AS schema_id, count(*) AS n_rows FROM p GROUP BY pattern
""",
    "archive_stats": f"""
{_E}
SELECT batch_id, 'event_id' AS field, count(*) AS n_records, count(event_id) AS n_elements, count(*)-count(event_id) AS n_null, CAST(min(event_id) AS DOUBLE) AS min_v, CAST(max(event_id) AS DOUBLE) AS max_v FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'user_id', count(*), count(user_id), count(*)-count(user_id), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'value', count(*), count(value), count(*)-count(value), min(value), max(value) FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'event_type', count(*), count(event_type), count(*)-count(event_type), NULL, NULL FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'props', count(*), count(props), count(*)-count(props), NULL, NULL FROM e GROUP BY batch_id
""",
    "archive_dictionaries": f"""
{_E}
SELECT batch_id, 'event_type' AS field, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY min(o))-1 AS INTEGER) AS code, event_type AS value FROM e GROUP BY batch_id, event_type
""",
    "archive_sizes": f"""
{_E}
SELECT batch_id, 'event_type' AS field, CAST(sum(strlen(event_type)) AS BIGINT) AS u_sz, md5(string_agg(event_type, '' ORDER BY o)) AS md5, true AS smaller FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'props', CAST(sum(strlen(props)) AS BIGINT), md5(string_agg(props, '' ORDER BY o)), true FROM e GROUP BY batch_id
""",
    "archive_describe": f"""
{_E}
SELECT 'event_id' AS field, 'bigint' AS ptype, 'COLUMN' AS layout, 'AUTO' AS transforms, count(event_id) AS n, count(DISTINCT batch_id) AS n_batches, CAST(0 AS BIGINT) AS u_sz, false AS folds FROM e
UNION ALL SELECT 'user_id', 'bigint', 'COLUMN', 'DELTA,ZSTD', count(user_id), count(DISTINCT batch_id), 8*count(*), true FROM e
UNION ALL SELECT 'event_type', 'string', 'TENSOR', 'AUTO', count(event_type), count(DISTINCT batch_id), CAST(sum(strlen(event_type)) AS BIGINT), true FROM e
UNION ALL SELECT 'value', 'double', 'COLUMN', 'ZSTD', count(value), count(DISTINCT batch_id), 8*count(*), true FROM e
UNION ALL SELECT 'props', 'string', 'TENSOR', 'RC_ILLUMINA_NAME', count(props), count(DISTINCT batch_id), CAST(sum(strlen(props)) AS BIGINT), true FROM e
""",
    "archive_decoded": f"""
{_E}
SELECT batch_id, o AS _ordinal, event_type, user_id, props FROM e
""",
    "archive_having": """
SELECT event_id, value FROM events WHERE event_type = 'purchase'
""",
    "archive_split": """
SELECT CAST((row_number() OVER (ORDER BY c_custkey)-1)//4096 AS INTEGER) AS batch_id, c_custkey, c_name, c_acctbal FROM customer
""",
    "bloom_by_batch": f"""
{_E}
SELECT batch_id, arg_min(user_id, o) AS user_id FROM e GROUP BY batch_id
""",
    "transform_roundtrip": """
SELECT CAST((row_number() OVER (ORDER BY o_orderkey)-1)//4096 AS INTEGER) AS batch_id, CAST(row_number() OVER (ORDER BY o_orderkey)-1 AS BIGINT) AS ordinal, o_custkey FROM orders
""",
    "transform_log": """
WITH o AS (SELECT CAST((row_number() OVER (ORDER BY o_orderkey)-1)//4096 AS INTEGER) AS batch_id FROM orders), n AS (SELECT batch_id, 8*count(*) AS sz FROM o GROUP BY batch_id)
SELECT batch_id, CAST(0 AS INTEGER) AS step, 'PLAIN' AS transform, sz AS u_sz, sz AS plain_sz, true AS has_md5 FROM n
UNION ALL SELECT batch_id, 1, 'DELTA', sz, sz, true FROM n UNION ALL SELECT batch_id, 2, 'ZSTD', sz, NULL, true FROM n
""",
    "auto_transform": f"""
{_E}
SELECT batch_id, 'event_type' AS field, count(*) AS n_rec, CASE WHEN count(DISTINCT event_type) < 0.3*count(event_type) THEN 'PLAIN,DICT,ZSTD' ELSE 'PLAIN,DELTA,ZSTD' END AS transforms FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'event_id', count(*), CASE WHEN count(DISTINCT event_id) < 0.2*count(event_id) THEN 'PLAIN,DICT,ZSTD' ELSE 'PLAIN,ZSTD' END FROM e GROUP BY batch_id
UNION ALL SELECT batch_id, 'user_id', count(*), CASE WHEN count(DISTINCT user_id) < 0.2*count(user_id) THEN 'PLAIN,DICT,ZSTD' ELSE 'PLAIN,ZSTD' END FROM e GROUP BY batch_id
""",
    "transform_orders": """
SELECT * FROM (VALUES ('', true), ('ZSTD', true), ('DICT,ZSTD', true), ('DICT,ZSTD,RC_BASES', true), ('AUTO', true), ('DICT,DICT', false), ('ZSTD,DICT', false), ('DICT,DELTA', false), ('AUTO,DICT,RC_QUAL', false)) t(transforms, valid)
""",
    "quality_codec": """
SELECT doc_id, md5(text) AS digest FROM documents
""",
    "base_codec": f"""
SELECT doc_id, md5(seq) AS digest FROM ({_BASES})
""",
    "name_codec": """
SELECT page_id AS doc_id, md5(url) AS digest FROM pages
""",
    "plain_codec": """
SELECT page_id AS doc_id, md5(html) AS digest FROM pages
""",
    "pack_bases": f"""
SELECT doc_id, CAST(length(seq) AS INTEGER) AS n_bases, CAST((length(seq)+3)//4 AS INTEGER) AS n_bytes, CAST(length(seq)-length(replace(seq,'N','')) AS INTEGER) AS n_other, md5(seq) AS digest FROM ({_BASES})
""",
    "fastq_scan": """
SELECT 'r.' || o_orderkey || ' L:1/2' AS name, 'r|' || o_orderkey || '|L|1|2' AS parts, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ACGTNACGTN') AS BASES, lpad(CAST(o_custkey AS VARCHAR), 8, 'I') AS QUAL FROM orders
""",
    "sam_scan": """
SELECT 'ST' AS NAME_1, o_orderkey AS NAME_2, 'H0' AS NAME_3, CAST(1 AS BIGINT) AS NAME_4, CAST(2 AS BIGINT) AS NAME_5, CAST(3 AS BIGINT) AS NAME_6, o_custkey AS NAME_7, CAST(99 AS INTEGER) AS FLAG, o_orderstatus AS RNAME, o_orderkey AS POS,
  CAST(60 AS SMALLINT) AS MAPQ, '8M' AS CIGAR, o_orderpriority AS RNEXT, CAST(-7 AS INTEGER) AS PNEXT, CAST(12 AS INTEGER) AS TLEN, 'ACGT' AS BASES, 'IIII' AS QUAL FROM orders
""",
    "sam_tags": """
SELECT o_orderkey AS POS, -o_custkey AS NM, 'a:b' AS RG, CAST(NULL AS DOUBLE) AS XX FROM orders
""",
    "sam_reference_ids": """
WITH v AS (SELECT o_orderkey*2 AS ord, o_orderstatus AS s FROM orders UNION ALL SELECT o_orderkey*2+1, o_orderpriority FROM orders),
d AS (SELECT s, CAST(row_number() OVER (ORDER BY min(ord))-1 AS INTEGER) AS id FROM v GROUP BY s)
SELECT o_orderkey AS POS, a.id AS RNAME_id, b.id AS RNEXT_id FROM orders JOIN d a ON o_orderstatus = a.s JOIN d b ON o_orderpriority = b.s
""",
    "vcf_scan": """
WITH r AS (SELECT p_brand AS s, CAST(row_number() OVER (ORDER BY min(p_partkey))-1 AS INTEGER) AS id FROM part GROUP BY p_brand),
f AS (SELECT f AS s, CAST(row_number() OVER (ORDER BY min(p_partkey))-1 AS INTEGER) AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'PASS' ELSE 'q10' END AS f FROM part) GROUP BY f)
SELECT p_brand AS RNAME, r.id AS RNAME_id, p_partkey AS POS, 'rs' || p_partkey AS NAME, 'A' AS REF, 'C,G' AS ALT, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 90 + 0.5 AS FLOAT) END AS QUAL,
  f.s AS FILTER, f.id AS FILTER_id, CAST(p_size AS VARCHAR) AS dp, '' AS db, 'a=b' AS x FROM part JOIN r ON p_brand = r.s JOIN f ON f.s = CASE WHEN p_partkey % 2 = 0 THEN 'PASS' ELSE 'q10' END
""",
    "vcf_genotypes": """
SELECT p_partkey AS POS, CAST(0 AS INTEGER) AS sample, CAST(0 AS INTEGER) AS hap, CAST(p_partkey % 3 AS SMALLINT) AS allele FROM part
UNION ALL SELECT p_partkey, 0, 1, CASE WHEN p_partkey % 5 <> 0 THEN 1 END FROM part UNION ALL SELECT p_partkey, 1, 0, 0 FROM part UNION ALL SELECT p_partkey, 1, 1, p_partkey % 2 FROM part
""",
    "vcf_columns": """
SELECT p_partkey AS POS, CAST(p_partkey % 3 AS SMALLINT) AS gt_0, CASE WHEN p_partkey % 5 <> 0 THEN CAST(1 AS SMALLINT) END AS gt_1, CAST(0 AS SMALLINT) AS gt_2, CAST(p_partkey % 2 AS SMALLINT) AS gt_3 FROM part
""",
    "bed_scan": """
SELECT o_orderstatus AS chrom, o_orderkey AS "start", o_orderkey + 9 AS "end", o_orderpriority AS name, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS strand FROM orders
""",
    "gff3_scan": """
SELECT o_orderstatus AS seqid, 'src' AS source, 'gene' AS type, o_orderkey AS "start", o_orderkey + 5 AS "end", '.' AS score, '+' AS strand, '0' AS phase, 'ID=g' || o_custkey AS attributes FROM orders
""",
    "gtf2_scan": """
SELECT o_orderstatus AS seqname, 'src' AS source, 'gene' AS feature, o_orderkey AS "start", o_orderkey + 5 AS "end", '.' AS score, '+' AS strand, '0' AS frame, 'ID=g' || o_custkey AS attributes FROM orders
""",
    "fasta_scan": f"""
SELECT 'd' || doc_id || ' x' AS name, CAST(length(coalesce(seq, '')) AS INTEGER) AS n, md5(coalesce(seq, '')) AS digest FROM ({_BASES})
""",
    "table_builder": """
WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey)-1 AS o, r_regionkey AS k, r_name AS n FROM region), m AS (SELECT count(*) AS c FROM region),
a AS (SELECT o, 0 AS s, k, n, NULL AS x, NULL AS y FROM r UNION ALL SELECT c + row_number() OVER (ORDER BY n_nationkey)-1, 1, NULL, n_name, n_nationkey, n_regionkey FROM nation, m)
SELECT CAST(o AS BIGINT) AS ordinal, CAST(o // 7 AS INTEGER) AS batch_id, CAST(s AS INTEGER) AS schema_id, CAST(k AS SMALLINT) AS region, n AS name, CAST(x AS INTEGER) AS keys_0, CAST(y AS INTEGER) AS keys_1, x || ',' || y AS pair FROM a
""",
    "table_fields": """
SELECT * FROM (VALUES (0, 'name', 'TEXT', 'COLUMN'), (1, 'region', 'UINT8', 'COLUMN'), (2, 'keys', 'INT32', 'COLUMN'), (3, 'pair', 'INT64', 'TENSOR')) t(field_id, name, ptype, layout)
""",
    "table_schemas": """
SELECT * FROM (VALUES (0, '1,0'), (1, '0,2,3')) t(schema_id, field_ids)
""",
    "field_ids": """
WITH f AS (SELECT event_id*10 AS a, 'event_id' AS name FROM events UNION ALL SELECT event_id*10+1, 'ts' FROM events
UNION ALL SELECT event_id*10+2, 'value' FROM events WHERE event_type='purchase' UNION ALL SELECT event_id*10+2, 'props' FROM events WHERE event_type='error')
SELECT name, CAST(row_number() OVER (ORDER BY min(a))-1 AS INTEGER) AS id FROM f GROUP BY name
""",
    "local_lookup": """
SELECT * FROM (VALUES ('event_id', 0), ('ts', 1), ('nothing', -1)) t(field, local_id)
""",
    "tensor_null_pad": """
WITH t AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN count(*) ELSE 0 END AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(sum(n) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS off_start, CAST(sum(n) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS off_end FROM t
""",
    "compression_fold": f"""
{_E}
SELECT 'user_id' AS field, CAST(1 AS DOUBLE) AS n_columns, 8*count(*) AS u_sz, true AS folds FROM e UNION ALL SELECT 'value', 1, 8*count(*), true FROM e
UNION ALL SELECT 'event_type', 1, CAST(sum(strlen(event_type)) AS BIGINT), true FROM e UNION ALL SELECT 'props', 1, CAST(sum(strlen(props)) AS BIGINT), true FROM e
""",
}
