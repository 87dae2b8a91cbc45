"""The same queries as SQL text, for comparison on the same tables."""

from __future__ import annotations

from quillgraph.functions.text import NAME_PUNCTUATION, REFUSAL_MARKERS
from quillgraph.operators.extraction import PATTERNS, RELATIONS
from quillgraph.operators.retrieval import COUNT_HINTS, PATH_HINTS, RELATION_HINTS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _norm(c: str) -> str:
    return f"translate(lower(coalesce({c}, '')), {_q(NAME_PUNCTUATION)}, '')"


def _mark(c: str) -> str:
    return f"translate(regexp_extract({c}, '[（(]([0-9０-９]{{1,3}})[）)]', 1), '０１２３４５６７８９', '0123456789')"


def _script(c: str) -> str:
    han, latin = f"regexp_matches({c}, '[一-鿿]')", f"regexp_matches({c}, '[A-Za-z]')"
    return f"CASE WHEN {han} AND {latin} THEN 'mixed' WHEN {han} THEN 'cjk' ELSE 'ascii' END"


def _verdict(a: str, b: str) -> str:
    return (
        f"CASE WHEN {_mark(a)} <> {_mark(b)} THEN 'incompatible' WHEN {_norm(a)} = '' OR {_norm(b)} = '' THEN 'incompatible' WHEN {_norm(a)} = {_norm(b)} THEN 'strong' "
        f"WHEN {_script(a)} <> {_script(b)} THEN 'incompatible' WHEN substring({_norm(a)}, 1, 2) <> substring({_norm(b)}, 1, 2) THEN 'incompatible' ELSE 'weak' END"
    )


def _tokens(c: str) -> str:
    pairs = f"flatten(list_transform(regexp_extract_all({c}, '[一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"
    return f"list_concat(list_concat({pairs}, list_transform(regexp_extract_all({c}, '[A-Za-z]+'), lambda w: lower(w))), regexp_extract_all({c}, '[0-9]+(?:\\.[0-9]+)?'))"


def _squash(c: str) -> str:
    return f"regexp_replace({c}, '[\\s　]+', '', 'g')"


def _uncited(c: str) -> str:
    return f"regexp_replace({c}, 'doc-[0-9]{{4,8}}|\\[[0-9]{{1,2}}\\]', '', 'g')"


REFUSES = _any("substring(coalesce(text, ''), 1, 160)", REFUSAL_MARKERS)
CHUNKS = "chunk AS (SELECT id, any_value(doc_id) AS doc_id, any_value(doc_title) AS doc_title, any_value(section) AS section, any_value(text) AS text, any_value(raw_text) AS raw_text, any_value(char_offset) AS char_offset FROM chunks GROUP BY id)"
ENTITY = "entity AS (SELECT id, any_value(entity_type) AS entity_type, any_value(name) AS name, any_value(aliases) AS aliases FROM entities GROUP BY id)"
ANSWER = "answer AS (SELECT DISTINCT ON (answer_id) * FROM answers)"
SEARCH = "search AS (SELECT id AS query, question AS text, qtype, gold_docs AS docs FROM eval_set WHERE CAST(substring(id, 3) AS INT) % 50 = 0)"
FORMS = f"{ENTITY}, form AS (SELECT form, min(id) AS entity FROM (SELECT id, name AS form FROM entity UNION ALL SELECT id, unnest(aliases) FROM entity) WHERE length(form) >= 2 GROUP BY form)"
EDGES = """raw AS (SELECT subject AS src, relation AS rel, CASE WHEN object_type = 'Literal' THEN 'lit:' || object ELSE object END AS dst, triple_id AS seq, source_doc FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL),
edge AS (SELECT src, rel, dst, min(seq) AS seq FROM raw GROUP BY ALL)"""
STEPS = f"""{EDGES},
step AS (SELECT src AS node, dst AS other, rel, 0 AS dir, seq FROM edge UNION ALL SELECT dst, src, rel, 1, seq FROM edge WHERE NOT starts_with(dst, 'lit:')),
degree AS (SELECT node, count(*) AS degree, sum(1 - literal) AS entity_degree FROM (
  SELECT src AS node, CAST(starts_with(dst, 'lit:') AS INT) AS literal FROM edge UNION ALL SELECT dst, 0 FROM edge) GROUP BY node),
hub AS (SELECT node FROM degree WHERE entity_degree > 12)"""


def _bm25(name: str, items: str, k: int) -> str:
    return f"""
    {name}_item AS ({items}),
    {name}_tok AS (SELECT item, unnest({_tokens("text")}) AS term FROM {name}_item),
    {name}_post AS (SELECT item, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY item) AS len FROM {name}_tok GROUP BY item, term),
    {name}_scalar AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len({_tokens("text")})) AS avg FROM {name}_item),
    {name}_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {name}_post GROUP BY term),
    {name}_idf AS (SELECT term, avg, greatest(ln(CAST(1 AS DOUBLE) + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), CAST(0.000001 AS DOUBLE)) AS idf FROM {name}_df, {name}_scalar),
    {name}_ask AS (SELECT DISTINCT query, unnest({_tokens("text")}) AS term FROM search),
    {name}_hit AS (SELECT query, item, round(sum(idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * CAST(len AS DOUBLE) / avg))), 6) AS score
        FROM {name}_post JOIN {name}_ask USING (term) JOIN {name}_idf USING (term) GROUP BY query, item),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM {name}_hit QUALIFY rank <= {k})"""


TEXTS = "SELECT id AS item, coalesce(text, '') AS text FROM chunk"
HEADINGS = "SELECT id AS item, concat_ws(' ', doc_title, section) AS text FROM chunk"
BM25 = f"WITH {CHUNKS}, {SEARCH}, {_bm25('best', TEXTS, 10)}"
METRICS = f"""{BM25.replace('rank <= 10', 'rank <= 20')},
doc AS (SELECT query, doc_id AS doc, min(rank) AS rank FROM best JOIN chunk ON chunk.id = best.item GROUP BY ALL),
want AS (SELECT query, qtype, len(docs) AS n, unnest(docs) AS doc FROM search WHERE len(docs) > 0),
metric AS (SELECT query, qtype,
  {", ".join(f"round(count(*) FILTER (rank <= {k}) / any_value(n), 6) AS recall_{k}, max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS hit_{k}" for k in (1, 3, 5, 10, 20))},
  round(coalesce(CAST(1 AS DOUBLE) / min(rank), 0), 6) AS rr FROM want LEFT JOIN doc USING (query, doc) GROUP BY query, qtype)"""
SCORED = f"""WITH {ANSWER}, q AS (SELECT id AS question_id, qtype, gold_entities, expect_refusal FROM eval_set),
row AS (SELECT *, {_squash(_uncited("coalesce(text, '')"))} AS squashed, {REFUSES} AS says_no FROM answer JOIN q USING (question_id)),
hit AS (SELECT *, CASE WHEN len(gold_entities) > 0 THEN CAST(len(list_filter(gold_entities, lambda g: contains(squashed, {_squash("g")}))) AS DOUBLE) / len(gold_entities) ELSE 1 END AS r FROM row),
scored AS (SELECT answer_id, question_id, qtype, prompt_id, says_no AS refused, CASE WHEN NOT expect_refusal THEN round(r, 6) END AS entity_recall,
  CASE WHEN NOT expect_refusal THEN CAST(len(gold_entities) > 0 AND r = 1 AS INT)::DOUBLE ELSE CAST(says_no AS INT)::DOUBLE END AS correct,
  CASE WHEN expect_refusal THEN CAST(says_no AS INT)::DOUBLE END AS refusal_correct,
  CASE WHEN NOT expect_refusal THEN CAST(says_no AND NOT (len(gold_entities) > 0 AND r = 1) AS INT)::DOUBLE END AS false_refusal FROM hit)"""
MENTION = f"{FORMS}, mention AS (SELECT e.id AS query, e.question AS text, form, entity, instr(e.question, form) AS pos FROM eval_set e JOIN form ON contains(e.question, form))"


def _walk(hops: int, where: str) -> str:
    levels = ["l0 AS (SELECT DISTINCT query, node, 0 AS hop FROM seed)"]
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT query, node FROM l{j}" for j in range(k))
        blocked = "" if k == 1 else "AND l.node NOT IN (SELECT node FROM hub)"
        levels.append(
            f"l{k} AS (SELECT DISTINCT l.query, s.other AS node, {k} AS hop FROM l{k - 1} l JOIN way s ON s.node = l.node WHERE NOT starts_with(l.node, 'lit:') {blocked} AND (l.query, s.other) NOT IN (SELECT (query, node) FROM ({seen})))"
        )
    union = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(hops + 1))
    return f"""WITH {STEPS}, way AS (SELECT DISTINCT node, other FROM step {where}),
    seed AS (SELECT triple_id AS query, subject AS node FROM triples WHERE subject IS NOT NULL AND CAST(substring(triple_id, 2) AS INT) % 50 = 0), {", ".join(levels)} {union}"""


def _paths(hops: int, limit: int) -> str:
    levels = [
        "p0 AS (SELECT pair, target, source AS cur, [source] AS nodes, CAST([] AS STRUCT(dir INT, seq VARCHAR)[]) AS ord, source AS path FROM pairs WHERE source <> target)"
    ]
    hits = []
    for k in range(1, hops + 1):
        blocked = "" if k == 1 else "AND p.cur NOT IN (SELECT node FROM hub)"
        levels.append(
            f"""g{k} AS (SELECT pair, target, other AS cur, list_append(nodes, other) AS nodes, list_append(ord, {{'dir': dir, 'seq': seq}}) AS ord,
            path || CASE WHEN dir = 0 THEN ' -[' || rel || ']-> ' ELSE ' <-[' || rel || ']- ' END || other AS path
            FROM p{k - 1} p JOIN step s ON s.node = p.cur WHERE NOT list_contains(nodes, other) {blocked}),
            p{k} AS (SELECT * FROM g{k} WHERE cur <> target AND NOT starts_with(cur, 'lit:'))"""
        )
        hits.append(f"SELECT pair, {k} AS hops, ord, path FROM g{k} WHERE cur = target")
    return f"""WITH {STEPS}, pairs AS (SELECT triple_id AS pair, subject AS source, object AS target FROM triples
      WHERE object_type = 'Character' AND subject IS NOT NULL AND object IS NOT NULL AND CAST(substring(triple_id, 2) AS INT) % 50 = 0),
    {", ".join(levels)}
    SELECT pair, hops, path, row_number() OVER (PARTITION BY pair ORDER BY hops, ord) AS place FROM ({" UNION ALL ".join(hits)}) QUALIFY place <= {limit}"""


CHAIN = "('PARENT_OF', 'COUSIN_OF', 'UNCLE_OF', 'PARTNER_OF', 'FRIEND_OF', 'LIKES', 'SEALED_BY', 'MEMBER_OF', 'LEADER_OF')"

SQL: dict[str, str] = {
    "tokenize_terms": f"WITH {CHUNKS}, tok AS (SELECT id, unnest({_tokens("coalesce(text, '')")}) AS term FROM chunk) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM tok GROUP BY term",
    "normalize_names": f"WITH {ENTITY} SELECT id, {_norm('name')} AS norm, {_script("coalesce(name, '')")} AS script, {_mark("coalesce(name, '')")} AS mark FROM entity",
    "lexical_verdict": f"WITH {ENTITY}, pair AS (SELECT DISTINCT id, name, unnest(aliases) AS alias FROM entity WHERE name IS NOT NULL) SELECT id, alias, {_verdict('name', 'alias')} AS verdict FROM pair WHERE alias IS NOT NULL",
    "split_assign": """WITH h AS (SELECT id, CAST(('0x' || substring(sha256(question), 1, 8)) AS UBIGINT)::DOUBLE / CAST(4294967295 AS DOUBLE) AS share FROM eval_set)
        SELECT id, CASE WHEN share < CAST(0.4 AS DOUBLE) THEN 'train' WHEN share < CAST(0.4 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'dev' ELSE 'test' END AS assigned FROM h""",
    "hash_embedding": f"""WITH {ENTITY}, w AS (SELECT id, unnest(CASE WHEN length(name) <= 2 THEN [name] ELSE list_transform(range(1, length(name)), lambda i: substring(name, i, 2)) END) AS w FROM entity WHERE name IS NOT NULL),
        c AS (SELECT id, CAST(CAST(('0x' || substring(md5(w), 1, 8)) AS UBIGINT) % 256 AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL)
        SELECT id, bucket, round(n / (sqrt(sum(n * n) OVER (PARTITION BY id)) + CAST(1e-9 AS DOUBLE)), 6) AS weight FROM c""",
    "keyword_occurrences": """WITH k AS (SELECT DISTINCT id, question, unnest(trap_keywords) AS keyword FROM eval_set)
        SELECT id, keyword, CASE WHEN length(keyword) > 0 THEN CAST((length(question) - length(replace(question, keyword, ''))) / length(keyword) AS INT) ELSE 0 END AS n FROM k""",
    "refusal_markers": f"WITH {ANSWER} SELECT answer_id, {REFUSES} AS refuses, length({_squash(_uncited("coalesce(text, '')"))}) AS length FROM answer",
    "pattern_extract": "WITH p(relation, pattern) AS (VALUES " + ", ".join(f"({_q(r)}, {_q(p)})" for r, p in PATTERNS) + "), hit AS ("
    + " UNION ALL ".join(f"SELECT id, {_q(r)} AS relation, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS object FROM documents" for r, p in PATTERNS)
    + ") SELECT DISTINCT id, relation, trim(object) AS object FROM hit WHERE trim(object) <> ''",
    "schema_validate": "WITH s(relation, ws, wo) AS (VALUES " + ", ".join(f"('{r}', '{a}', '{b}')" for r, (a, b) in RELATIONS.items()) + """)
        SELECT CASE WHEN trim(coalesce(subject, '')) = '' OR trim(coalesce(object, '')) = '' THEN 'empty_name' WHEN ws IS NULL THEN 'unknown_relation'
          WHEN subject_type IS DISTINCT FROM ws OR object_type IS DISTINCT FROM wo THEN 'wrong_type' ELSE 'ok' END AS reason, relation, count(*) AS n
        FROM triples LEFT JOIN s USING (relation) GROUP BY ALL""",
    "triple_dedupe": "SELECT triple_id, source_doc, subject, relation, object FROM triples QUALIFY row_number() OVER (PARTITION BY source_doc, subject, relation, object ORDER BY triple_id) = 1",
    "evidence_check": f"""WITH r AS (SELECT triple_id, list_filter(list_transform(regexp_split_to_array(coalesce(evidence, ''), '[·•|+；;…]|\\.\\.\\.'), lambda p: {_squash("p")}), lambda p: length(p) >= 2) AS pt, {_squash("coalesce(evidence, '')")} AS ev, {_squash("coalesce(d.text, '')")} AS body
        FROM triples t JOIN documents d ON d.id = t.source_doc), r2 AS (SELECT triple_id, CASE WHEN ev = '' THEN [] WHEN len(pt) = 0 THEN [ev] ELSE pt END AS ps, body FROM r), f AS (SELECT triple_id, len(ps) AS parts, len(list_filter(ps, lambda p: contains(body, p))) AS found FROM r2)
        SELECT triple_id, parts, found, parts = found AS verbatim FROM f""",
    "mention_collect": """WITH e AS (SELECT triple_id, 0 AS pos, subject AS name, subject_type AS type, evidence FROM triples UNION ALL SELECT triple_id, 1, object, object_type, evidence FROM triples WHERE object_type <> 'Literal')
        SELECT name, last(type ORDER BY triple_id, pos) AS type, first(substring(coalesce(evidence, ''), 1, 120) ORDER BY triple_id, pos) AS context FROM e WHERE name <> '' GROUP BY name""",
    "candidate_pairs": f"""WITH n AS (SELECT DISTINCT entity_type, name, substring({_norm('name')}, 1, 2) AS head FROM entities WHERE name <> '' AND entity_type IS NOT NULL),
        p AS (SELECT x.entity_type, x.name AS a, y.name AS b FROM n x JOIN n y ON x.entity_type = y.entity_type AND x.head = y.head AND x.name < y.name)
        SELECT entity_type, a, b, {_verdict('a', 'b')} AS verdict FROM p WHERE {_verdict('a', 'b')} <> 'incompatible'""",
    "same_names": f"""WITH n AS (SELECT DISTINCT entity_type, name, {_norm('name')} AS norm FROM entities WHERE name <> '' AND entity_type IS NOT NULL)
        SELECT entity_type, norm, first(name ORDER BY length(name) DESC, name) AS representative, count(*) AS names FROM n WHERE norm <> '' GROUP BY entity_type, norm HAVING count(*) > 1""",
    "edge_merge_sources": f"""WITH {EDGES}, doc AS (SELECT src, rel, dst, source_doc, min(seq) AS pos FROM raw GROUP BY ALL),
        l AS (SELECT src, rel, dst, list(source_doc ORDER BY pos) AS docs FROM doc GROUP BY ALL) SELECT src, rel, dst, docs[1] AS source_doc, array_to_string(docs[2:], ',') AS extra FROM l""",
    "graph_degrees": f"WITH {STEPS} SELECT node, degree, CAST(entity_degree AS BIGINT) AS entity_degree, entity_degree > 12 AS hub FROM degree",
    "graph_stats": f"WITH {EDGES} SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edge GROUP BY rel",
    "neighbors_1hop": f"""WITH {STEPS}, n AS (SELECT DISTINCT subject AS node FROM triples WHERE subject IS NOT NULL AND CAST(substring(triple_id, 2) AS INT) % 50 = 0)
        SELECT node, other, rel, dir, row_number() OVER (PARTITION BY node ORDER BY dir, seq) AS place, count(*) OVER (PARTITION BY node) AS total FROM step JOIN n USING (node) QUALIFY place <= 30""",
    "find_paths": _paths(3, 5),
    "relation_chain": _walk(3, f"WHERE rel IN {CHAIN}"),
    "neighborhood": _walk(2, ""),
    "list_by_relation": f"SELECT relation, target, count(*) AS subjects FROM (SELECT DISTINCT relation, {_norm('object')} AS target, subject FROM triples WHERE relation IN ('LEADER_OF', 'MEMBER_OF') AND object IS NOT NULL) GROUP BY ALL",
    "bm25_topk": f"{BM25} SELECT query, item, score, rank FROM best",
    "dense_topk": """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 10""",
    "rrf_fusion": f"""WITH {CHUNKS}, {SEARCH}, {_bm25('t', TEXTS, 30)}, {_bm25('h', HEADINGS, 30)},
        u AS (SELECT query, item, CAST(1 AS DOUBLE) / (60 + rank) AS part, 0 AS place, 'text' AS source FROM t UNION ALL SELECT query, item, CAST(1 AS DOUBLE) / (60 + rank), 1, 'heading' FROM h),
        m AS (SELECT query, item, round(sum(part), 9) AS score, array_to_string(list(source ORDER BY place), '+') AS sources FROM u GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM m QUALIFY rank <= 10""",
    "cascade_merge": f"""WITH {CHUNKS}, {SEARCH}, {_bm25('t', TEXTS, 10)}, {_bm25('h', HEADINGS, 10)},
        head AS (SELECT query, item, 0 AS stage, rank FROM h WHERE rank <= 5), u AS (SELECT * FROM head UNION ALL SELECT query, item, 1, rank FROM t WHERE (query, item) NOT IN (SELECT (query, item) FROM head))
        SELECT query, item, stage, row_number() OVER (PARTITION BY query ORDER BY stage, rank) AS place FROM u QUALIFY place <= 10""",
    "round_robin_emit": f"""WITH {CHUNKS}, {SEARCH}, h AS (SELECT query, unnest(docs) AS doc, generate_subscripts(docs, 1) AS hop FROM search),
        r AS (SELECT query, doc, hop, id AS item, row_number() OVER (PARTITION BY query, doc ORDER BY coalesce(char_offset, 0), id) - 1 AS turn FROM h JOIN chunk ON chunk.doc_id = h.doc)
        SELECT query, item, round(CAST(1 AS DOUBLE) / hop - turn * CAST(0.0001 AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query ORDER BY turn, hop, doc) AS place FROM r QUALIFY place <= 10""",
    "entity_mentions": f"""WITH {MENTION} SELECT query, form, entity, CAST(pos AS INT) AS "at" FROM mention""",
    "route_question": f"""WITH {MENTION}, n AS (SELECT query, count(DISTINCT entity) AS linked FROM mention GROUP BY query),
        r AS (SELECT id AS query, question AS text, coalesce(linked, 0) AS linked FROM eval_set LEFT JOIN n ON n.query = eval_set.id),
        f AS (SELECT query, linked, CASE WHEN linked = 0 THEN 'no entity' WHEN linked >= 2 AND {_any('text', PATH_HINTS)} THEN 'path' WHEN {_any('text', COUNT_HINTS)} AND {_any('text', RELATION_HINTS)} THEN 'aggregation'
          WHEN {_any('text', RELATION_HINTS)} THEN 'relation' ELSE 'attribute' END AS reason FROM r)
        SELECT query, linked, CASE WHEN reason IN ('path', 'aggregation', 'relation') THEN 'graph' ELSE 'lexical' END AS route, reason FROM f""",
    "context_pack": f"""WITH {ANSWER}, {CHUNKS}, u AS (SELECT answer_id AS query, unnest(context_chunks) AS id, generate_subscripts(context_chunks, 1) AS p FROM answer),
        r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY p) AS place, doc_title, raw_text FROM u JOIN chunk USING (id)),
        b AS (SELECT query, place, sum(length('[' || place || ']（来源：' || coalesce(doc_title, '') || '）\n' || coalesce(raw_text, ''))) OVER (PARTITION BY query ORDER BY place) AS running FROM r)
        SELECT query, count(*) AS blocks, CAST(max(running) AS BIGINT) AS characters FROM b WHERE running <= 9000 OR place = 1 GROUP BY query""",
    "citation_validate": f"""WITH {ANSWER}, m AS (SELECT DISTINCT answer_id, context_chunks, CAST(unnest(regexp_extract_all(text, '\\[([0-9]{{1,2}})\\]', 1)) AS INT) AS idx FROM answer)
        SELECT answer_id, idx, CASE WHEN idx >= 1 THEN context_chunks[idx] END AS chunk_id, (CASE WHEN idx >= 1 THEN context_chunks[idx] END) IS NOT NULL AS valid FROM m""",
    "extractive_answer": f"WITH {CHUNKS}, {SEARCH}, {_bm25('best', TEXTS, 1)} SELECT query, substring(replace(coalesce(raw_text, ''), '\n', ' '), 1, 300) || '[1]' AS answer FROM best JOIN chunk ON chunk.id = best.item",
    "cache_lookup": f"""WITH {ANSWER}, r AS (SELECT result_key, max(model) AS model, max(input_tokens) AS i, max(output_tokens) AS o, max(alias_hit) AS alias_hit FROM llm_results GROUP BY result_key)
        SELECT model, count(*) AS answers, count(model) AS hits, count(*) FILTER (coalesce(alias_hit, false)) AS alias_hits, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM answer LEFT JOIN r USING (result_key) GROUP BY model""",
    "retrieval_metrics": f"{METRICS} SELECT * FROM metric",
    "metrics_rollup": f"{METRICS} SELECT coalesce(qtype, 'all') AS qtype, count(*) AS questions, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(rr), 6) AS rr FROM metric GROUP BY ROLLUP (qtype)",
    "answer_score": f"{SCORED} SELECT * EXCLUDE (question_id) FROM scored",
    "answer_score_by_type": f"{SCORED} SELECT qtype, count(*) AS answers, " + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in ("entity_recall", "correct", "refusal_correct", "false_refusal")) + " FROM scored GROUP BY qtype",
    "prompt_pivot": f"{SCORED} SELECT qtype, " + ", ".join(f"round(coalesce(avg(correct) FILTER (prompt_id = 'answer/{p}'), 0), 6) AS {p}" for p in ("v1_naive", "v2_cited", "v3_guarded")) + " FROM scored GROUP BY qtype",
    "ab_flips": f"""{SCORED}, per AS (SELECT question_id, prompt_id, max(correct) AS c FROM scored WHERE correct IS NOT NULL GROUP BY ALL)
        SELECT o.question_id, CASE WHEN n.c > o.c THEN 'fixed' ELSE 'broken' END AS flip FROM per o JOIN per n USING (question_id) WHERE o.prompt_id = 'answer/v1_naive' AND n.prompt_id = 'answer/v3_guarded' AND o.c <> n.c""",
    "refusal_confusion": f"WITH {ANSWER} SELECT expect_refusal, refused, {REFUSES} AS says_no, count(*) AS n FROM answer JOIN eval_set q ON q.id = answer.question_id GROUP BY ALL",
    "extraction_prf": """WITH f AS (SELECT DISTINCT extractor, relation, subject, object FROM triples), a AS (SELECT relation, subject, object, 1 AS f FROM f WHERE extractor = 'rule'), b AS (SELECT relation, subject, object, 1 AS g FROM f WHERE extractor = 'v4_structural'),
        j AS (SELECT coalesce(a.relation, b.relation) AS relation, a.f, b.g FROM a FULL JOIN b ON a.relation = b.relation AND a.subject = b.subject AND a.object = b.object),
        c AS (SELECT relation, count(f) AS found, count(g) AS gold, count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) AS "right" FROM j GROUP BY relation)
        SELECT *, round(coalesce("right" / nullif(found, 0), 0), 6) AS precision, round(coalesce("right" / nullif(gold, 0), 0), 6) AS recall, round(2 * "right" / (found + gold), 6) AS f1 FROM c""",
    "dq_missing_gold": """WITH q AS (SELECT id, qtype, gold_docs FROM eval_set WHERE NOT expect_refusal), u AS (SELECT id, qtype, unnest(gold_docs) AS doc FROM q UNION ALL SELECT id, qtype, NULL FROM q WHERE coalesce(len(gold_docs), 0) = 0)
        SELECT qtype, count(DISTINCT u.id) AS questions, count(*) FILTER (doc IS NULL) AS without, count(doc) AS named, count(d.id) AS existing FROM u LEFT JOIN documents d ON d.id = u.doc GROUP BY qtype""",
    "dq_gold_entity_absent": """WITH q AS (SELECT * FROM eval_set WHERE NOT derived AND NOT expect_refusal), p AS (SELECT id, unnest(gold_entities) AS entity, gold_docs FROM q), r AS (SELECT id, entity, unnest(gold_docs) AS doc FROM p)
        SELECT r.id, entity FROM r JOIN documents d ON d.id = r.doc GROUP BY ALL HAVING NOT bool_or(contains(coalesce(text, ''), entity))""",
    "dq_split_leak": "SELECT question, count(DISTINCT split) AS splits, count(*) AS rows FROM eval_set WHERE question IS NOT NULL GROUP BY question HAVING count(DISTINCT split) > 1",
    "dataset_summary": """SELECT coalesce(qtype, 'all') AS qtype, coalesce(split, 'all') AS split, count(*) AS questions, count(*) FILTER (expect_refusal) AS traps, CAST(grouping(qtype, split) AS INT) AS level FROM eval_set
        GROUP BY CUBE (qtype, split) HAVING grouping(qtype, split) < 3""",
    "read_document": "SELECT id, substring(coalesce(text, ''), 1, 1500) AS body, length(coalesce(text, '')) > 1500 AS truncated FROM documents",
    "find_entity": f"""WITH {ENTITY}, f AS (SELECT id, coalesce(name, '') AS form FROM entity UNION SELECT id, unnest(aliases) FROM entity), s(stem) AS (VALUES ('合唱团'), ('学堂'), ('岛'), ('choir'), ('island'))
        SELECT stem, count(DISTINCT f.id) AS records FROM f JOIN s ON contains(lower(form), lower(stem)) GROUP BY 1""",
}
