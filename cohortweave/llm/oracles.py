"""SQL for DuckDB that checks the queries which SQL can express."""

from __future__ import annotations

from cohortweave.llm.quality_rules import POLICIES, RULES

_WORDS = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""WITH w AS (SELECT doc_id, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g)>1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i,i+5)) AS p FROM rep) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(*)-count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{_WORDS}') GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws,''))::BIGINT AS word_chars, length(regexp_replace(t,'[^#*$%&|<>]','','g'))::BIGINT AS n_symbols,
coalesce(lines.dup,0)::BIGINT AS n_dup_lines, coalesce(cov.n,0)::BIGINT AS n_repeat_words, coalesce(lines.n,0) AS n_lines, length(regexp_replace(t,'[^A-Z]','','g')) AS up, length(regexp_replace(t,'[^a-z]','','g')) AS low,
length(regexp_replace(t,'[^!]','','g')) AS bangs, len(list_filter(range(2,len(ws)+1), lambda i: ws[i]=ws[i-1])) AS stutter FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words<10 THEN 1 ELSE 0 END + CASE WHEN 100*n_repeat_words>20*n_words THEN 2 ELSE 0 END + CASE WHEN 100*n_symbols>10*n_words THEN 4 ELSE 0 END + CASE WHEN 100*up>40*(up+low) THEN 8 ELSE 0 END
+ CASE WHEN 100*bangs>30*n_words THEN 16 ELSE 0 END + CASE WHEN 100*n_dup_lines>50*n_lines THEN 32 ELSE 0 END + CASE WHEN 100*stutter>30*n_words THEN 64 ELSE 0 END + CASE WHEN word_chars<2*n_words OR word_chars>25*n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""

_MASKS = ", ".join(f"('{p}', {mask}, '{r.name}', {1 << k})" for p, mask in POLICIES.items() for k, r in enumerate(RULES) if mask >> k & 1)
QUALITY_ABLATION = QUALITY_RULES.rsplit("\n", 1)[0] + f"""
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only_this,
count(*) FILTER (fail_bits & mask IN (0, bit)) AS n_kept_without FROM b, (VALUES {_MASKS}) v(policy, mask, rule, bit) GROUP BY policy, rule"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-3)) AS i FROM w) UNION ALL SELECT doc_id, array_to_string(ws,' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*k>=80*(x.n+y.n-k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk(node, other) AS (SELECT a, b FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.other=e.a),
c AS (SELECT node, min(other) AS m FROM walk GROUP BY 1)
SELECT w.doc_id, coalesce(n.n,0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON node=w.doc_id"""

WARC = """WITH x AS (SELECT page_id, coalesce(html,'') AS h, strlen(coalesce(html,'')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n>=100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM x)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN page_id>first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id>first THEN first END AS refers_to FROM f"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label=b.label AND a.vec_id<>b.vec_id WHERE list_cosine_similarity(a.x,b.x)>=0.93),
walk(node, other) AS (SELECT a, b FROM l UNION SELECT walk.node, l.b FROM walk JOIN l ON walk.other=l.a),
c AS (SELECT node, min(other) AS m FROM walk GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n,0)::BIGINT AS n_links, least(vec_id, coalesce(m,vec_id)) AS component_id, vec_id<=coalesce(m,vec_id) AS kept FROM embeddings LEFT JOIN k ON a=vec_id LEFT JOIN c ON node=vec_id"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: bytes come in by xor, and each is followed by eight steps, -1, of the polynomial."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x'||substr(hex(encode({text})), 1+2*i::INT, 2))::BIGINT)"
    steps = f"flatten(list_transform({data}, lambda b: [b,-1,-1,-1,-1,-1,-1,-1,-1]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, b: CASE WHEN b>=0 THEN xor(c,b) WHEN c%2=1 THEN xor(c//2, 3988292384::BIGINT) ELSE c//2 END), 4294967295::BIGINT)"


SPELLING = rf"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT run, k, coalesce(doc_id::VARCHAR,'')||':'||run AS t FROM (SELECT doc_id, run, count(*) AS k FROM r GROUP BY 1,2)),
h AS (SELECT run, k, {_crc32("t")} AS h FROM d),
c AS (SELECT CASE WHEN h%97=0 THEN substring(run,1,h%length(run))||substring(run,h%length(run)+2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM c WHERE length(word)>=5 GROUP BY 1 HAVING sum(k)>=3),
x AS (SELECT word, i, substring(word,1,i-1)||substring(word,i+1) AS v FROM (SELECT word, unnest(range(1,length(word)+1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.v=b.v AND a.i=b.i AND a.word<>b.word UNION SELECT x.word, w.word FROM x JOIN w ON x.v=w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.v=w.word),
q AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p JOIN w ON word=b),
f AS (SELECT w.word, w.n, coalesce(n_near,0)::BIGINT AS n_near, CASE WHEN q.n>=2*w.n THEN b END AS form, CASE WHEN q.n>=2*w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON a=w.word AND k=1),
walk(word, last, nxt) AS (SELECT word, word, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word=nxt)
SELECT f.word, form, last AS root, n, n_near, form_n FROM f JOIN walk ON walk.word=f.word WHERE nxt IS NULL"""


def _merkle(levels: int = 20, top: int = 10) -> str:
    """Trees of at most 2**levels leaves for each of at most 2**top langs, a statement for each level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR)||':'||({c})::VARCHAR END"
    digest = lambda chars: "sha256(" + "||".join(map(field, ("doc_id", "source", "lang", chars, "text"))) + ")"
    parts = [
        f"d AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id FROM (SELECT doc_id, lang, {digest('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')}%7=0 THEN {digest('n_chars+1')} END AS other FROM documents))",
        "a0 AS MATERIALIZED (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY id)-1 AS i, leaf AS x, count(*) OVER (PARTITION BY lang) AS m FROM d)",
        "pa0 AS MATERIALIZED (SELECT id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY id)-1 AS i, coalesce(other, leaf) AS f, '' AS s FROM d)",
    ]

    def tree(t: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, i//2 AS i, CASE WHEN max(m)=1 THEN min(x) ELSE sha256(string_agg(x, '' ORDER BY i)) END AS x, (max(m)+1)//2 AS m FROM {t}{k} GROUP BY g, i//2)")
            parts.append(
                f"p{t}{k + 1} AS MATERIALIZED (SELECT id, p.g, p.i//2 AS i, CASE WHEN o.m=1 THEN f WHEN b.x IS NULL THEN sha256(f) WHEN p.i%2=1 THEN sha256(b.x||f) ELSE sha256(f||b.x) END AS f, s||coalesce(b.x,'') AS s FROM p{t}{k} p"
                f" JOIN {t}{k} o ON o.g IS NOT DISTINCT FROM p.g AND o.i=p.i LEFT JOIN {t}{k} b ON b.g IS NOT DISTINCT FROM p.g AND b.i=xor(p.i,1))"
            )

    tree("a", levels)
    parts.append(f"b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST)-1 AS i, x, count(*) OVER () AS m, g AS lang FROM a{levels})")
    parts.append(f"pb0 AS MATERIALIZED (SELECT id, 0 AS g, b0.i, f, s FROM pa{levels} p JOIN b0 ON b0.lang IS NOT DISTINCT FROM p.g)")
    tree("b", top)
    return "WITH " + ",\n".join(parts) + f"\nSELECT d.doc_id, leaf, b0.x AS subroot, r.x AS root, sha256(s) AS proof_sha256, f AS folded_root, f=r.x AS verified FROM d JOIN pb{top} USING (id) JOIN b0 ON b0.lang IS NOT DISTINCT FROM d.lang CROSS JOIN b{top} r"


SQL = {"op3_jaccard_join": JACCARD, "op4_quality_rules": QUALITY_RULES, "quality_ablation": QUALITY_ABLATION, "op6_warc": WARC, "op10_embedding_dedup": EMBEDDINGS, "op11_spelling_variants": SPELLING, "op13_merkle_manifest": _merkle()}
