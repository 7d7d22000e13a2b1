"""SQL of the vector, conversation and privacy queries."""

from __future__ import annotations

PARTS, ENTRIES, ROUNDS = 4, 256, 4


def vector_codes_sql() -> str:
    """Four rounds over all (part, entry) pairs of a row, in one statement; components are whole numbers in doubles."""
    steps = [
        f"""kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT vec_id, label, p, list_slice(q, CAST(p * len(q) // {PARTS} + 1 AS BIGINT), CAST((p + 1) * len(q) // {PARTS} AS BIGINT)) AS x FROM kept, range({PARTS}) r(p)
        ), book0 AS (
            SELECT p, k, c, list_dot_product(c, c) AS cc FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM parts) WHERE k < {ENTRIES}
        )"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS (
            SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + cc, 'k': k}}) AS best
            FROM parts JOIN book{i} USING (p) GROUP BY vec_id, p
        )""")
        if i < ROUNDS:
            steps.append(f"""mean{i} AS (
                SELECT p, k, list(m ORDER BY j) AS c FROM (
                    SELECT p, k, j, floor(sum(v) / count(*)) AS m FROM (SELECT p, best.k AS k, unnest(x) AS v, unnest(range(len(x))) AS j FROM near{i}) GROUP BY p, k, j) GROUP BY p, k
            ), book{i + 1} AS (
                SELECT p, k, c, list_dot_product(c, c) AS cc FROM (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.k = b.k)
            )""")
    last = ROUNDS
    return f"""
        WITH {", ".join(steps)}, coded AS (
            SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best.k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{last}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
    """


_VISIBLE = r"[^\x20\x09-\x0D]"


def conversation_repair_sql() -> str:
    """The repair's four states row after row as a recursive query; CRC-32 byte after byte."""

    def then(state: str, letter: str, cost: str, out: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {out}}}"

    turn = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
    stays = "CASE WHEN bad THEN 1000000 WHEN truncated THEN 1 ELSE 0 END"

    def kept(state: str, initial: str) -> str:
        return then(state, "K", f"CASE WHEN initial = '{initial}' THEN {stays} ELSE 1000000 END", "chr(10) || role || ':' || text")

    def closed(src: str, carry: str) -> str:
        """start, system, user and assistant of src after inserts."""
        first = f"SELECT {carry}, st, sy, least(us, {then('st', 'I', '2', turn['user'])}, {then('sy', 'I', '2', turn['user'])}, {then('asst', 'I', '2', turn['user'])}) AS us, asst FROM {src}"
        return f"SELECT {carry}, st, sy, us, least(asst, {then('us', 'I', '2', turn['assistant'])}) AS asst FROM ({first})"

    impossible = "{'c': 1000000, 'a': '', 'o': ''}"
    return rf"""
        WITH RECURSIVE bits(n, v, k) AS (
            SELECT n, n, 0 FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc_table AS (
            SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
        ), coded AS (
            SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS code FROM keyed, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM coded, range(2) r(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen
            FROM (SELECT *, role[1] AS initial, row_number() OVER w AS place, lag(role[1]) OVER w AS before, NOT regexp_matches(text, '{_VISIBLE}') AS blank FROM damaged
                WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        ), flagged AS (
            SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') AS truncated,
                blank OR seen AS bad, before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed
        ), convs AS (
            SELECT c.conv_id, count(place) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
                count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
        ), fold(conv_id, n, pos, st, sy, us, asst) AS (
            SELECT conv_id, n, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'o': ''}}, {impossible}, {impossible}, {impossible} FROM convs
            UNION ALL
            SELECT conv_id, n, pos, {then('st', 'D', '3')},
                least({then('sy', 'D', '3')}, {kept('st', 's')}),
                least({then('us', 'D', '3')}, {kept('best', 'u')}, {then('best', 'R', f'2 + {stays}', turn['user'] + ' || text')}),
                least({then('asst', 'D', '3')}, {kept('us', 'a')}, {then('us', 'R', f'2 + {stays}', turn['assistant'] + ' || text')})
            FROM (
                SELECT c.conv_id, n, place AS pos, st, sy, us, asst, least(st, sy, asst) AS best, f.role, f.text, f.initial, f.bad, f.truncated
                FROM ({closed('fold', 'conv_id, n, pos')}) c JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.place = c.pos + 1)
        ), ended AS (
            SELECT conv_id, least(st, asst) AS best FROM ({closed('fold', 'conv_id, n, pos')}) WHERE pos = n
        )
        SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.o[2:]) AS repaired_sha256
        FROM convs c JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """


def disclosure_sql() -> str:
    """Personal data and disclosing terms, with the contract's plain patterns; offsets are running sums over the pieces between matches."""
    email, ip, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"\+[0-9][\x20().0-9-]+[0-9]"
    card, term = r"[0-9](?:[\x20-]?[0-9])+", r"[\p{L}\p{N}_]{3,}"
    long_card = r"[0-9](?:[\x20-]?[0-9]){13,}"
    either = "|".join((email, phone, long_card, ip))

    def placed(source: str, keys: str, text: str, pattern: str) -> str:
        """keys, m, start (from 0) and i (from 1) of every match."""
        return rf"""SELECT {keys}, m, i, CAST(sum(length(piece) + CASE WHEN i > 1 THEN length(ms[i - 1]) ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS start FROM (
            SELECT {keys}, ms, unnest(ms) AS m, unnest(pieces[1:len(ms)]) AS piece, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS pieces FROM {source}))"""

    def valid(kind: str) -> str:
        digits = "regexp_replace(m, '[^0-9]', '', 'g')"
        return {
            "email": "true",
            "ip": "len(list_filter(string_split(m, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(TRY_CAST(o AS HUGEINT), 999) > 255)) = 0",
            "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN (length({digits}) - k) % 2 = 0 THEN CAST({digits}[k] AS INT) ELSE 2 * CAST({digits}[k] AS INT) - CASE WHEN {digits}[k] > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
            "phone": f"length({digits}) BETWEEN 10 AND 15",
        }[kind]

    kinds = {"email": email, "ip": ip, "card": card, "phone": phone}
    base = " UNION ALL ".join(f"SELECT row, start, {at} AS kind_at, '{k}' AS kind, start + length(m) AS stop FROM ({placed('docs', 'row', 'text', p)}) WHERE {valid(k)}" for at, (k, p) in enumerate(kinds.items()))
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    entity = f"CASE WHEN contains(m, '@') THEN 'email:' || lower(m) WHEN m[1] = '+' THEN CASE WHEN {valid('phone')} THEN 'phone:' || {digits} END WHEN contains(m, '.') THEN CASE WHEN {valid('ip')} THEN 'ip:' || m END ELSE CASE WHEN {valid('card')} THEN 'card:' || {digits} END END"

    def words(text: str) -> str:
        return f"list_filter(regexp_extract_all(lower({text}), '{term}'), lambda t: length(t) <= 64)"

    plain = f"regexp_replace(text, '{either}', ' ', 'g')"
    return rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
        ), base AS ({base}
        ), cut AS (
            SELECT row, text, regexp_extract_all(text, '{either}') AS ms, string_split_regex(text, '{either}') AS pieces FROM docs WHERE row IN (SELECT row FROM base)
        ), near AS (
            SELECT row, text, {entity} AS entity, {words('ahead')} AS ahead, {words('behind')} AS behind
            FROM (SELECT row, text, unnest(ms) AS m, unnest(pieces[1:len(ms)]) AS ahead, unnest(pieces[2:len(ms) + 1]) AS behind FROM cut)
        ), pairs AS (
            SELECT DISTINCT row, text, entity, term FROM (SELECT row, text, entity, unnest(list_concat(ahead[greatest(len(ahead) - 9, 1):], behind[1:10])) AS term FROM near WHERE entity IS NOT NULL)
        ), paired AS (
            SELECT entity, term, count(*) AS n_both FROM pairs GROUP BY entity, term HAVING count(*) >= 2 AND min(text) < max(text)
        ), entities AS (
            SELECT entity, count(DISTINCT row) AS n_entity FROM near WHERE entity IS NOT NULL GROUP BY entity
        ), terms AS (
            SELECT term, count(*) AS n_term FROM (SELECT DISTINCT row, unnest({words(plain)}) AS term FROM docs) WHERE term IN (SELECT term FROM paired) GROUP BY term
        ), going AS (
            SELECT entity, term, log2(n_term / n_both) <= 0.15 AS removed FROM (SELECT *, (SELECT count(*) FROM docs) AS n FROM paired JOIN entities USING (entity) JOIN terms USING (term))
            WHERE log2(n / n_entity) - log2(n_term / n_both) >= 0.5 * log2(n / n_entity) AND n > n_entity AND log2(n_term / n_both) <= 1.0
        ), flagged AS (
            SELECT row, term, max(removed) AS removed FROM pairs JOIN going USING (entity, term) GROUP BY row, term
        ), masked AS (
            SELECT row, array_to_string(list_transform(range(1, len(pieces) + 1), lambda k: pieces[k] || repeat(' ', coalesce(length(ms[k]), 0))), '') AS text FROM cut WHERE row IN (SELECT row FROM flagged)
        ), gone AS (
            SELECT p.row, p.start, 4 AS kind_at, 'term' AS kind, p.start + length(m) AS stop, removed FROM ({placed('masked', 'row', 'text', term)}) p JOIN flagged f ON f.row = p.row AND f.term = lower(p.m)
            WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = p.row AND b.start < p.start + length(p.m) AND p.start < b.stop)
        ), spans AS (
            SELECT *, NULL AS removed FROM base UNION ALL SELECT * FROM gone
        ), told AS (
            SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_at) FILTER (kind_at < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_at) AS spans,
                count(*) FILTER (kind_at = 4) AS n_terms, count(*) FILTER (removed) AS n_removed
            FROM spans GROUP BY row
        )
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
            coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms, coalesce(n_removed, 0) AS n_removed
        FROM docs LEFT JOIN told USING (row)
    """
