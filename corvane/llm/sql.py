"""DuckDB counterparts of the queries, as brute force over whole tables."""


def _words(x: str) -> str:
    bare = rf"regexp_replace(nfc_normalize(translate({x},'İIı','iii')),'[\p{{Cf}}\p{{M}}]','','g')"
    return rf"regexp_extract_all(lower(strip_accents({bare})),'[\p{{L}}\p{{N}}]+')"


_P2 = rf"""WITH r AS (SELECT DISTINCT id, list_distinct({_words("question")}) w, set_name,
 list_distinct(list_filter(list_transform(expect_files, lambda f: regexp_replace(replace(trim(f),'\','/'),'^(\./+)+','')), lambda f: f IS NOT NULL AND f<>'')) files,
 CASE WHEN split IS NULL OR trim(split)='' THEN 'dev' ELSE lower(regexp_replace(split,'^\s+|\s+$','','g')) END s FROM questions WHERE id IS NOT NULL),
 f AS (SELECT DISTINCT id, w, s, set_name, unnest(files) f FROM r WHERE len(w)>0),
 p AS (SELECT DISTINCT d.id d, e.id e, e.s, e.set_name, len(list_intersect(d.w, e.w)) c, len(d.w) nd, len(e.w) ne FROM f d JOIN f e ON d.f=e.f WHERE d.s='dev' AND e.s IN ('test','holdout')),
 hit AS (SELECT * FROM p WHERE c>=0.6*(nd+ne-c)-1e-9)"""

ORACLES: dict[str, str] = {
    "p2_found": _P2 + " SELECT DISTINCT least(d,e) id_a, greatest(d,e) id_b FROM hit WHERE d<>e",
    "p2_report": _P2
    + """, b AS (SELECT e, s, set_name, max(c/ne) best FROM hit GROUP BY ALL), a AS (SELECT DISTINCT id, s, set_name FROM r WHERE s IN ('test','holdout'))
 SELECT a.s eval_split, a.set_name, count(*) records, count(best) overlapping, round_even(count(best)/count(*),6) "share", round_even(avg(best),6) mean_best_overlap
 FROM a LEFT JOIN b ON b.e=a.id AND b.s=a.s AND b.set_name IS NOT DISTINCT FROM a.set_name GROUP BY ALL""",
    "p3_found": r"""WITH RECURSIVE c AS (SELECT ord, arg_max(text, coalesce(epoch_us(indexed_at),0)) text FROM chunks WHERE source='code' AND ord IS NOT NULL AND text IS NOT NULL GROUP BY ord),
 w AS (SELECT ord, regexp_extract_all(lower(text),'[\p{L}\p{N}_]+') w FROM c),
 g AS MATERIALIZED (SELECT DISTINCT ord, w[i]||' '||w[i+1] b FROM (SELECT ord, w, unnest(range(1,len(w))) i FROM w WHERE len(w)>=40)),
 n AS (SELECT ord, count(*) n FROM g GROUP BY ord),
 e AS MATERIALIZED (SELECT a, b FROM (SELECT x.ord a, y.ord b, count(*) k FROM g x JOIN g y ON x.b=y.b AND x.ord<y.ord GROUP BY ALL) p
 JOIN n na ON na.ord=p.a JOIN n nb ON nb.ord=p.b WHERE k>=0.6*(na.n+nb.n-k)-1e-9),
 sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach(o, r) AS (SELECT a, a FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a=reach.o)
 SELECT o AS ord, min(r) group_ord FROM reach GROUP BY o""",
    "p4_found": """WITH v0 AS (SELECT provider, content_hash, vec::DOUBLE[] v FROM vectors WHERE content_hash IS NOT NULL AND vec IS NOT NULL),
 d0 AS (SELECT provider, len(v) d, count(*) n FROM v0 WHERE len(v)>0 GROUP BY provider, len(v)),
 d AS (SELECT provider, d FROM d0 QUALIFY row_number() OVER (PARTITION BY provider ORDER BY n DESC, d DESC)=1),
 v AS (SELECT provider, content_hash, min(v) v FROM v0 JOIN d USING (provider) WHERE len(v)=d AND len(list_filter(v, lambda x: NOT isfinite(x)))=0 AND list_max(list_transform(v, lambda x: abs(x)))>0 GROUP BY ALL),
 s AS (SELECT a.provider, a.content_hash a, b.content_hash b, list_cosine_similarity(a.v,b.v) c FROM v a JOIN v b ON a.provider=b.provider AND a.content_hash<>b.content_hash),
 t AS (SELECT * FROM s WHERE c>=0.8 QUALIFY row_number() OVER (PARTITION BY provider, a ORDER BY c DESC, b)<=5)
 SELECT DISTINCT provider, least(a,b) hash_a, greatest(a,b) hash_b FROM t""",
    "p8_found": f"""WITH d AS (SELECT DISTINCT doc_id, {_words("text")} w FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT passage_id, {_words("text")} w FROM eval_passages WHERE text IS NOT NULL),
 ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11],' ') s FROM (SELECT doc_id, w, unnest(range(1,len(w)-10)) i FROM d)),
 ps AS (SELECT DISTINCT passage_id, array_to_string(w[i:i+11],' ') s FROM (SELECT passage_id, w, unnest(range(1,len(w)-10)) i FROM p))
 SELECT DISTINCT doc_id, passage_id FROM ds JOIN ps USING (s)""",
    # what must hold of results that SQL can't compute
    "p4_recall": "SELECT DISTINCT provider, true reached FROM vectors WHERE provider IS NOT NULL",
    "p6_check": """SELECT ord, md5(text) AS text, coalesce(start_line,1) first_line, coalesce(start_line,1)+len(text)-len(replace(text,chr(10),'')) last_line, true in_limits FROM
 (SELECT *, row_number() OVER (PARTITION BY ord, CASE WHEN ord IS NULL THEN hash(text, start_line, kind) END ORDER BY indexed_at DESC NULLS LAST, text, start_line, kind) rn FROM chunks WHERE length(text)>1500) WHERE rn=1""",
    "p7_check": 'SELECT doc_id, max(coalesce(length(text),0))::INT chars, true "right" FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id',
    "p7_containers": "SELECT 0::BIGINT overfull, true tight",
    "p9_check": "SELECT 0::BIGINT overlapping, 0::BIGINT ragged, 0::BIGINT across, 0::BIGINT wordless",
}
