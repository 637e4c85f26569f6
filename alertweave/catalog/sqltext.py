"""SQL fragments shared by the oracle statements."""

KEYED = """
keyed AS (
  SELECT event_id AS row_id, 's' || (user_id % 8)::VARCHAR AS scenario,
         's' || (user_id % 8)::VARCHAR || '::m' || (user_id % 24)::VARCHAR AS machine,
         (floor(epoch(ts) / 900)::BIGINT) * 900 AS timestamp,
         event_type || ':' || (regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 8)::VARCHAR AS event_key,
         event_type, user_id, value,
         CASE WHEN value > 100 THEN 1 ELSE 0 END AS event_incident,
         CASE WHEN value > 100 THEN 's' || (user_id % 8)::VARCHAR || '::' || event_type END AS event_incident_group
  FROM events)
"""

VOCAB = """
vocab AS (SELECT event_key, row_number() OVER (ORDER BY event_key) - 1 AS event_id
          FROM (SELECT DISTINCT event_key FROM keyed))
"""

ALERTS = KEYED.strip() + ",\n" + VOCAB.strip() + """,
alerts AS (
  SELECT k.*, v.event_id,
         CASE WHEN substr(k.event_key, 1, 1) IN ('c', 'e') THEN 'AMiner'
              WHEN substr(k.event_key, 1, 1) IN ('p', 's') THEN 'Suricata' ELSE 'Wazuh' END AS detector
  FROM keyed k JOIN vocab v ON k.event_key = v.event_key)
"""

INTERVALS = """
intervals AS (SELECT scenario, event_type AS attack, timestamp AS s, timestamp + 7200 AS e, row_id AS position
              FROM keyed WHERE value > 300)
"""


def history(n: int, timeout: int = 86400, name: str = "ctx") -> str:
    """Strict-past context per alert: `name(row_id, c)` with slot structs oldest first."""
    return f"""
{name}_h AS (
  SELECT row_id, machine, timestamp,
         list({{'t': timestamp, 'r': row_id, 'e': event_id, 'i': event_incident, 'g': event_incident_group}})
           OVER (PARTITION BY machine ORDER BY timestamp, row_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS h
  FROM alerts),
{name}_f AS (
  SELECT row_id, timestamp,
         first_value(h) OVER (PARTITION BY machine, timestamp ORDER BY row_id) AS h
  FROM {name}_h),
{name} AS (
  SELECT row_id, coalesce(list_filter(h, lambda x: timestamp - x.t <= {timeout}), []) AS c FROM {name}_f)
"""


FOLDS = """
scen AS (SELECT scenario, row_number() OVER (ORDER BY scenario) - 1 AS pos, count(*) OVER () AS n
         FROM (SELECT DISTINCT scenario FROM keyed)),
folds AS (
  SELECT t.scenario AS test_scenario, s.scenario,
         CASE WHEN s.pos = t.pos THEN 'test' WHEN s.pos = (t.pos + 1) % t.n THEN 'validation' ELSE 'train' END AS role
  FROM scen t CROSS JOIN scen s)
"""


def h32(*parts: str) -> str:
    """32-bit md5 key of the parts joined by a vertical bar."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


BUDGET, RATIO, SEEDS = 550, 10, (11, 23)

REVEAL = f"""
seeds AS (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed),
tr AS (SELECT f.test_scenario, s.seed, a.*, {h32('s.seed', 'a.row_id')} AS k
       FROM alerts a JOIN folds f ON a.scenario = f.scenario CROSS JOIN seeds s WHERE f.role = 'train'),
posr AS (SELECT *, row_number() OVER (PARTITION BY test_scenario, seed, event_incident_group ORDER BY k, row_id) AS rd
         FROM tr WHERE event_incident = 1),
poss AS (SELECT *, row_number() OVER (PARTITION BY test_scenario, seed
                ORDER BY rd, {h32('seed', 'rd', 'event_incident_group')}, row_id) AS rn FROM posr),
negs AS (SELECT *, row_number() OVER (PARTITION BY test_scenario, seed ORDER BY k, row_id) AS rn
         FROM tr WHERE event_incident = 0),
revealed AS (
  SELECT test_scenario, seed, scenario, row_id, event_id, event_key, event_incident, event_incident_group
  FROM poss WHERE rn <= {max(1, BUDGET // (RATIO + 1))}
  UNION ALL
  SELECT test_scenario, seed, scenario, row_id, event_id, event_key, event_incident, event_incident_group
  FROM negs WHERE rn <= {min(BUDGET - max(1, BUDGET // (RATIO + 1)), max(1, BUDGET // (RATIO + 1)) * RATIO)})
"""

WINDOWED = """
seg AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY s, position) AS ord FROM intervals),
windowed AS (
  SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM intervals i WHERE i.scenario = a.scenario
                                AND a.timestamp BETWEEN i.s AND i.e) THEN 1 ELSE 0 END AS window_incident
  FROM alerts a)
"""

RULES_TRAIN = """
rt AS (
  SELECT f.test_scenario, a.event_key, sum(event_incident) AS positive, count(*) AS total,
         count(*) - sum(event_incident) AS negative, sum(event_incident) / count(*) AS incident_rate
  FROM alerts a JOIN folds f ON a.scenario = f.scenario WHERE f.role = 'train' GROUP BY 1, 2)
"""

LINES = """
lines AS (
  SELECT doc_id AS seq_id,
         CASE WHEN doc_id % 10 < 3 THEN 'train' WHEN coalesce(toxic, 0) = 1 THEN 'test_abnormal' ELSE 'test_normal' END AS source,
         coalesce(toxic, 0) AS label,
         array_to_string([len(w) for w in string_split_regex(text, '[ \\n]+')], ' ') AS line
  FROM documents LEFT JOIN labels USING (doc_id))
"""

SPLITS = """
digest AS (SELECT *, sha256(line) AS h FROM lines),
digits AS (SELECT *, list_sum([('0x' || x)::BIGINT for x in string_split(h, '')])::BIGINT % 5 AS m5,
                  ('0x' || substr(h, 64, 1))::BIGINT % 2 AS par FROM digest),
bucketed AS (SELECT *, CASE WHEN m5 % 2 = par THEN m5 ELSE m5 + 5 END AS bucket FROM digits),
split AS (SELECT seq_id, source, label, line, CASE WHEN source = 'train' THEN 0 WHEN bucket <= 3 THEN 1
                 WHEN bucket <= 5 THEN 2 ELSE 3 END AS split FROM bucketed)
"""
