"""Queries: free text, codes, dates, bins and registry rows."""

from pyspark.sql import functions as F

from ..functions import coding, dates, missing, text
from ..functions import vocabulary as V
from ..plans import cohort, facts
from .registry import query

# registry-like columns derived from customer; the same expressions run in both engines
PEOPLE = {
    "person_id": "CAST(c_custkey AS STRING)",
    "history": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '고혈압, 당뇨' WHEN 'BUILDING' THEN 'HTN; 뇌졸중' WHEN 'HOUSEHOLD' THEN '심근경색 (PTCA)' WHEN 'MACHINERY' THEN '고지혈증' END",
    "smoking_text": "CASE c_nationkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'P' WHEN 2 THEN 'Past' END",
    "family_history": "CASE c_nationkey % 3 WHEN 0 THEN '어머니, 아버지' WHEN 1 THEN '없음' ELSE '이모, 언니' END",
    "ApoE": "CASE c_nationkey % 5 WHEN 0 THEN 'E3/E4' WHEN 1 THEN 'ND' WHEN 2 THEN 'E3/E3' WHEN 3 THEN 'E2/E4' END",
    "education": "CASE c_custkey % 7 WHEN 0 THEN '고졸' WHEN 1 THEN '대졸' WHEN 2 THEN '12' WHEN 3 THEN '대학원졸' WHEN 4 THEN '초중퇴' WHEN 5 THEN '기타' END",
    "known_years": "CASE WHEN c_custkey % 11 = 0 THEN 5.0 END",
    "gender": "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END",
    "birth_short": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lpad(CAST(30 + c_custkey % 40 AS STRING), 2, '0') || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') END",
    "registered": "CASE c_custkey % 4 WHEN 0 THEN '2019/' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '/15' WHEN 1 THEN '20200' || CAST(1 + c_custkey % 9 AS STRING) || '07' WHEN 2 THEN '2018-03-0' || CAST(1 + c_custkey % 9 AS STRING) ELSE 'unknown' END",
    "age_text": "CASE WHEN c_custkey % 17 = 0 THEN '?' ELSE CAST(50 + c_custkey % 30 AS STRING) END",
    "cost": "CASE c_custkey % 6 WHEN 0 THEN CAST(1 + c_custkey % 9 AS STRING) || '만원' WHEN 1 THEN CAST(10000 + c_custkey AS STRING) || '원 정도' WHEN 2 THEN CAST(1 + c_custkey % 8 AS STRING) || '만' WHEN 3 THEN CAST(1 + c_custkey % 90 AS STRING) || ' 원 ?' WHEN 4 THEN '모름' END",
    "height": "CAST(150 + c_custkey % 40 AS STRING)",
    "weight": "CASE WHEN c_custkey % 19 = 0 THEN 'ND' ELSE CAST(45 + c_custkey % 50 AS STRING) END",
    "cigarettes": "CAST(c_custkey % 70 AS STRING)",
    "sex_age": "CASE WHEN c_custkey % 2 = 0 THEN '남/' ELSE '여/' END || CAST(50 + c_custkey % 30 AS STRING)",
    "allele": "CASE c_nationkey % 3 WHEN 0 THEN 'e3e4' WHEN 1 THEN 'e4e4' ELSE 'none' END",
    "visit_date": "CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '2020-01-0' || CAST(1 + c_custkey % 9 AS STRING) END",
    "drinking": "CASE c_custkey % 5 WHEN 0 THEN 'Ox' WHEN 1 THEN 'Social' WHEN 2 THEN 'x' WHEN 3 THEN 'unclear' END",
    "sbp": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(100 + c_custkey % 60 AS STRING) END",
    "dbp": "CAST(60 + c_custkey % 30 AS STRING)",
}


def people(t, *names):
    return t.customer.select(*[F.expr(PEOPLE[n]).alias(n) for n in ("person_id", *names)])


def people_sql(*names):
    return "p AS (SELECT " + ", ".join(f'{PEOPLE[n].replace("AS STRING", "AS VARCHAR")} AS "{n}"' for n in ("person_id", *names)) + " FROM customer)"


def three(pattern: str, c: str, hit: int = 1, miss: int = 0) -> str:
    return f"CASE WHEN regexp_matches({c}, '{pattern}') THEN {hit} WHEN {c} IS NOT NULL THEN {miss} END::DOUBLE"


HISTORY_SQL = ", ".join(f"{three('|'.join(w), 'history')} AS {n}" for n, w in V.HISTORY_WORDS.items())


@query("C1 C5", f"""WITH {people_sql('smoking_text', 'family_history', 'ApoE', 'history')} SELECT person_id, {three('|'.join(V.SMOKER), 'smoking_text')} AS smoking,
 {three('|'.join(V.NO_FAMILY_HISTORY), 'family_history', 0, 1)} AS family_history_dementia,
 CASE WHEN contains("ApoE", 'E4') THEN 1 WHEN contains("ApoE", 'ND') THEN NULL WHEN "ApoE" IS NOT NULL THEN 0 END::DOUBLE AS apoe_e4, {HISTORY_SQL} FROM p""")
def keyword_flags(t):
    flags = text.risk_flags("smoking_text", "family_history", "ApoE", "history")
    return people(t, "smoking_text", "family_history", "ApoE", "history").select("person_id", *[c.cast("double").alias(n) for n, c in flags.items()])


@query("C5 C1", """SELECT doc_id, regexp_matches(text, '(?i)license|copyright')::INTEGER AS license, regexp_matches(text, '[0-9]{3}')::INTEGER AS digits FROM documents""")
def document_flags(t):
    return t.documents.select("doc_id", text.matches("text", "license|copyright", True).cast("int").alias("license"),
                              text.keyword_flag("text", ["[0-9]{3}"]).alias("digits"))


@query("C2", f"""WITH {people_sql('education', 'known_years')} SELECT person_id, coalesce(known_years, CASE WHEN regexp_matches(education, '^[0-9]+$') THEN TRY_CAST(education AS DOUBLE) END,
 CASE {' '.join(f"WHEN regexp_matches(education, '{p}') THEN {v}" for p, v in V.SCHOOLING_YEARS)} END)::DOUBLE AS years FROM p""")
def education_years(t):
    return people(t, "education", "known_years").select("person_id", text.education_years("education", "known_years").alias("years"))


@query("C3 C4 C10 C13", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS code, lower(o_orderpriority) AS low, (o_orderpriority LIKE '5%')::INTEGER AS starts, (o_orderpriority LIKE '%M')::INTEGER AS ends FROM orders""")
def recoded_orders(t):
    flag = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    return t.orders.select("o_orderkey", text.recode("o_orderstatus", {"F": "final", "O": "open"}).alias("status"), text.no_yes_unknown(flag).alias("code"),
                           F.lower("o_orderpriority").alias("low"), F.col("o_orderpriority").startswith("5").cast("int").alias("starts"),
                           F.col("o_orderpriority").endswith("M").cast("int").alias("ends"))


@query("C6 C7 C8 C12", """SELECT p_partkey, regexp_replace(p_name, 'e', '3') AS first_e, regexp_replace(p_name, 'e', '3', 'g') AS all_e, regexp_replace(p_name, '[aeiou]', '') AS drop_first,
 regexp_replace(p_name, '[aeiou]', '', 'g') AS drop_all, regexp_extract(p_brand, '[0-9]+') AS brand_no, substr(p_brand, 2) AS tail, p_type || '/' || p_brand AS pasted, length(p_name) AS size FROM part""")
def edited_names(t):
    return t.part.select("p_partkey", text.replace_first("p_name", "e", "3").alias("first_e"), text.replace_all("p_name", "e", "3").alias("all_e"),
                         text.remove_first("p_name", "[aeiou]").alias("drop_first"), text.remove_all("p_name", "[aeiou]").alias("drop_all"),
                         text.extract("p_brand", r"\d+").alias("brand_no"), text.drop_first_char("p_brand").alias("tail"),
                         text.paste("p_type", "p_brand", sep="/").alias("pasted"), F.length("p_name").cast("bigint").alias("size"))


@query("C7 C26", """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k FROM events""")
def extract_number(t):
    return t.events.select("event_id", missing.number(text.extract("props", r'"k": (\d+)', 1)).alias("k"))


@query("C9", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def packed_line_counts(t):
    return t.documents.select("doc_id", text.pieces("text").cast("bigint").alias("lines"))


@query("C11 C14", f"""WITH {people_sql('allele', 'sex_age')} SELECT person_id, regexp_replace(upper(allele), '^(E[0-9])(E[0-9])$', '\\1/\\2') AS allele, split_part(sex_age, '/', 1) AS sex, split_part(sex_age, '/', 2) AS age FROM p""")
def split_and_rewrite(t):
    return people(t, "allele", "sex_age").select("person_id", text.allele_pair("allele").alias("allele"),
                                                 *[c.alias(n) for n, c in text.split_fields("sex_age", ["sex", "age"], "/").items()])


BIRTH_SQL = "TRY_STRPTIME('19' || birth_short, '%Y%m%d')::DATE"
REG_SQL = "coalesce(TRY_STRPTIME(registered, '%Y-%m-%d'), TRY_STRPTIME(registered, '%Y%m%d'), TRY_STRPTIME(registered, '%Y/%m/%d'))::DATE"


@query("C16 C17 C18 C19", f"""WITH {people_sql('birth_short', 'registered', 'age_text')}, d AS (SELECT *, {BIRTH_SQL} AS b, {REG_SQL} AS r FROM p)
SELECT person_id, CAST(b AS VARCHAR) AS birth, CAST(r AS VARCHAR) AS registered, date_diff('day', b, r)::DOUBLE AS days,
 CASE WHEN b IS NULL THEN TRY_CAST(age_text AS DOUBLE) ELSE floor(date_diff('day', b, r) / 365.0) END AS age FROM d""")
def dates_and_ages(t):
    d = people(t, "birth_short", "registered", "age_text").withColumns({"b": dates.with_century("birth_short"), "r": dates.lenient_date("registered")})
    return d.select("person_id", F.col("b").cast("string").alias("birth"), F.col("r").cast("string").alias("registered"),
                    dates.days_between("r", "b").cast("double").alias("days"), dates.age_at("r", "b", "age_text").alias("age"))


@query("C20 S10", "SELECT o_orderstatus, '2021-03-05' AS run_date, count(*) AS n FROM orders GROUP BY ALL")
def run_stamp(t):
    return t.orders.groupBy("o_orderstatus", dates.run_date("2021-03-05").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("n"))


@query("C21 C23 C25 C26", f"""WITH {people_sql('height', 'weight', 'cigarettes')} SELECT person_id, round(TRY_CAST(weight AS DOUBLE) / (TRY_CAST(height AS DOUBLE) / 100) ** 2, 6) AS bmi,
 CASE WHEN c >= 60 THEN '6' WHEN c >= 40 THEN '5' WHEN c >= 30 THEN '4' WHEN c >= 20 THEN '3' WHEN c >= 10 THEN '2' WHEN c >= 1 THEN '1' END AS smoking_b, round(sqrt(c), 6) AS root, ceil(c / 7) AS weeks, abs(c - 30) AS gap
 FROM (SELECT *, TRY_CAST(cigarettes AS DOUBLE) AS c FROM p)""")
def numeric_codes(t):
    d = people(t, "height", "weight", "cigarettes").withColumn("c", missing.number("cigarettes"))
    w = missing.number(missing.null_if("weight"))
    return d.select("person_id", coding.body_mass_index(w, missing.number("height")).alias("bmi"), coding.smoking_code("cigarettes").alias("smoking_b"),
                    F.sqrt("c").alias("root"), F.ceil(F.col("c") / 7).cast("double").alias("weeks"), F.abs(F.col("c") - 30).alias("gap"))


@query("C22", f"""WITH {people_sql('cost')}, s AS (SELECT person_id, TRY_CAST(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cost, '원[가-힣]*', ''), '만', '0000'), '원', '000'), '[\\p{{L}}\\s?]', '', 'g') AS BIGINT) AS a FROM p)
SELECT person_id, (CASE WHEN a < 10000 THEN a * 10000 ELSE a END)::DOUBLE AS amount FROM s""")
def money_amounts(t):
    return people(t, "cost").select("person_id", text.money("cost").cast("double").alias("amount"))


@query("C24", f"""WITH {people_sql('family_history')} SELECT person_id, regexp_replace(CASE WHEN contains(family_history, '어머니') THEN '1' ELSE '' END || CASE WHEN contains(family_history, '아버지') THEN '2' ELSE '' END
 || CASE WHEN regexp_matches(family_history, '자매|동생|누나|언니') THEN '4' ELSE '' END || CASE WHEN regexp_matches(family_history, '할머니|외가|이모') THEN '5' ELSE '' END, '12', '3') AS code FROM p""")
def relative_code(t):
    return people(t, "family_history").select("person_id", text.relative_code("family_history").alias("code"))


@query("C25", f"""WITH {people_sql('visit_date', 'ApoE')} SELECT person_id, nullif(visit_date, '-') AS visit_date, nullif("ApoE", 'ND') AS "ApoE" FROM p""")
def sentinels_to_missing(t):
    return people(t, "visit_date", "ApoE").select("person_id", missing.null_if("visit_date").alias("visit_date"), missing.null_if("ApoE").alias("ApoE"))


@query("C27", f"""WITH {people_sql('history', 'ApoE', 'family_history')} SELECT person_id, coalesce(history, "ApoE", family_history) AS first_known FROM p""")
def first_known_value(t):
    return people(t, "history", "ApoE", "family_history").select("person_id", missing.first_known("history", "ApoE", "family_history").alias("first_known"))


@query("C28", """WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FILTER (o_orderstatus = 'F') AS x, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FILTER (o_orderstatus <> 'F') AS y
 FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_concat(x, list_filter(y, lambda v: NOT list_contains(x, v))), chr(10)) AS lines FROM s WHERE x IS NOT NULL AND y IS NOT NULL""")
def line_unions(t):
    # a set of priorities is bounded by the number of priorities
    side = lambda test: F.sort_array(F.collect_set(F.when(test, F.col("o_orderpriority"))))
    packed = t.orders.groupBy("o_custkey").agg(side(F.col("o_orderstatus") == "F").alias("x"), side(F.col("o_orderstatus") != "F").alias("y"))
    packed = packed.filter((F.size("x") > 0) & (F.size("y") > 0))
    return packed.select("o_custkey", text.line_union(F.array_join("x", "\n"), F.array_join("y", "\n")).alias("lines"))


@query("C29 C30", """WITH f AS (SELECT l_orderkey, max((l_returnflag = 'R')::INTEGER) AS a, max((l_discount > 0.05)::INTEGER) AS b, CASE WHEN count(*) > 2 THEN max((l_tax > 0.04)::INTEGER) END AS c FROM lineitem GROUP BY ALL)
SELECT l_orderkey, (a + b + c = 3)::INTEGER::DOUBLE AS all_three, (a + b + c >= 1)::INTEGER::DOUBLE AS some, (a = 1 OR b = 1 OR c = 1)::INTEGER::DOUBLE AS any_three FROM f""")
def flag_combinations(t):
    m = lambda c: F.max(c.cast("int"))
    f = t.lineitem.groupBy("l_orderkey").agg(m(F.col("l_returnflag") == "R").alias("a"), m(F.col("l_discount") > 0.05).alias("b"),
                                             F.when(F.count(F.lit(1)) > 2, m(F.col("l_tax") > 0.04)).alias("c"))
    return f.select("l_orderkey", text.all_flags("a", "b", "c").cast("double").alias("all_three"), text.some_flags("a", "b", "c").cast("double").alias("some"),
                    text.any_flag("a", "b", "c").cast("double").alias("any_three"))


@query("C4 C5 C12 C24", f"""WITH {people_sql('drinking', 'sbp', 'dbp', 'gender')} SELECT person_id, CASE WHEN regexp_matches(drinking, '(?i)^o|^p|social') THEN 1 WHEN regexp_matches(drinking, '(?i)^x|^n') THEN 0 END::DOUBLE AS alcohol,
 coalesce(sbp, 'NA') || '/' || dbp AS blood_pressure, sbp || '/' || dbp AS strict, CASE gender WHEN 'M' THEN 'Male' ELSE 'Female' END AS gender, (coalesce(regexp_matches(drinking, '(?i)o'), false))::INTEGER AS mentioned FROM p""")
def survey_codes(t):
    return people(t, "drinking", "sbp", "dbp", "gender").select(
        "person_id", text.answered("drinking", "^o|^p|social", "^x|^n").cast("double").alias("alcohol"), text.paste("sbp", "dbp", sep="/", missing="NA").alias("blood_pressure"),
        text.paste("sbp", "dbp", sep="/").alias("strict"), text.recode("gender", V.SEX_NAMES).alias("gender"), text.answered("drinking", "o").alias("mentioned"))


@query("P3 L5 C2 C1 C17 U1", f"""WITH {people_sql('smoking_text', 'family_history', 'ApoE', 'history', 'education', 'gender', 'birth_short', 'registered', 'age_text', 'visit_date')},
d AS (SELECT *, {BIRTH_SQL} AS b, {REG_SQL} AS r FROM p)
SELECT 'P-' || person_id AS master_no, CASE WHEN CAST(person_id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS dementia, CASE gender WHEN 'M' THEN 'Male' ELSE 'Female' END AS gender, CAST(b AS VARCHAR) AS birth_date,
 (CASE WHEN birth_short IS NULL THEN TRY_CAST(age_text AS DOUBLE) ELSE floor(date_diff('day', b, r) / 365.0) END) AS age_new, nullif(visit_date, '-') AS visit_date,
 {three('고혈압|혈압약|HTN', 'history')} AS hypertension, coalesce(CASE WHEN regexp_matches(education, '^[0-9]+$') THEN TRY_CAST(education AS DOUBLE) END,
 CASE {' '.join(f"WHEN regexp_matches(education, '{p}') THEN {v}" for p, v in V.SCHOOLING_YEARS)} END)::DOUBLE AS education_year FROM d""")
def registry_rows(t):
    """Patients and controls stacked, typed and flagged."""
    raw = people(t, "smoking_text", "family_history", "ApoE", "history", "education", "gender", "birth_short", "registered", "age_text", "visit_date")
    raw = raw.withColumn("No", F.concat(F.lit("P_"), F.col("person_id")))
    even = F.pmod(F.col("person_id").cast("bigint"), F.lit(2)) == 0
    rows = cohort.registry_rows(raw.filter(even), raw.filter(~even).withColumn("extra", F.lit("x")),
                                {"No": "master_no", "birth_short": "birth_date", "registered": "registration_date", "age_text": "age"}, "master_no", "19")
    out = cohort.add_risk_flags(rows)
    return out.select("master_no", "dementia", "gender", "birth_date", "age_new", "visit_date", F.col("hypertension").cast("double").alias("hypertension"), "education_year")


@query("R6 S12", f"""WITH {people_sql('gender', 'birth_short')} SELECT person_id, CASE gender WHEN 'M' THEN 'Male' ELSE 'Female' END AS gender, birth_short AS birth_date FROM p""")
def person_facts(t):
    return facts.person_facts(people(t, "gender", "birth_short"), "person_id", "gender", "birth_short")


@query("R6 R3", f"""WITH {people_sql('height', 'weight', 'sbp', 'dbp', 'registered')} SELECT person_id, c AS measurement_concept, registered AS measurement_date, v AS value_as_number FROM (
 SELECT person_id, registered, 'Height' AS c, height AS v FROM p UNION ALL SELECT person_id, registered, 'Weight', weight FROM p UNION ALL SELECT person_id, registered, 'Systolic blood pressure', sbp FROM p
 UNION ALL SELECT person_id, registered, 'Diastolic blood pressure', dbp FROM p) WHERE v IS NOT NULL""")
def vital_facts(t):
    wide = people(t, "height", "weight", "sbp", "dbp", "registered")
    return facts.vital_measurements(wide, "person_id", "registered", {"height": "Height", "weight": "Weight", "sbp": "Systolic blood pressure", "dbp": "Diastolic blood pressure"})


@query("R6 C15", """SELECT user_id, CASE event_type WHEN 'click' THEN 'Mini mental test examination' ELSE 'Geriatric depression scale' END AS measurement_concept, CAST(CAST(ts AS DATE) AS VARCHAR) AS measurement_date, value AS value_as_number
 FROM events WHERE event_type IN ('click', 'error') AND value >= 5""")
def measurement_facts(t):
    rows = t.events
    shown = F.when(F.col("value") < 5, "ND").otherwise(F.col("value").cast("string"))
    cell = lambda kind, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", c.alias("v"))))), lambda s: s["v"]), "\n")
    day = F.date_format("ts", "yyyy-MM-dd")
    # at most 64 events per packed cell, as ids are unique
    wide = rows.groupBy("user_id", F.floor(F.col("event_id") / 64)).agg(cell("click", shown).alias("mmse"), cell("click", day).alias("mmse_date"), cell("error", shown).alias("gds"), cell("error", day).alias("gds_date"))
    out = facts.packed_measurements(wide, "user_id", {"mmse": ("mmse_date", V.MEASUREMENT_CONCEPTS["MMSE"]), "gds": ("gds_date", V.MEASUREMENT_CONCEPTS["GDS"])})
    return out.select(F.col("person_id").alias("user_id"), "measurement_concept", F.col("measurement_date").cast("string").alias("measurement_date"), F.col("value_as_number").cast("double").alias("value_as_number"))


@query("R6 R3 J10", """WITH w AS (SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderstatus = 'F' AS h, o_orderpriority = '5-LOW' AS s, o_totalprice > 200000 AS f FROM orders)
SELECT id AS person_id, 'Past history' AS observation_concept, d AS observation_date, 'Hypertension' AS value_as_string FROM w WHERE h UNION ALL SELECT id, 'Smoking', d, 'TRUE' FROM w WHERE s
UNION ALL SELECT id, 'Family history', d, 'Dementia' FROM w WHERE f""")
def observation_facts(t):
    w = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("d"), (F.col("o_orderstatus") == "F").alias("h"),
                        (F.col("o_orderpriority") == "5-LOW").alias("s"), (F.col("o_totalprice") > 200000).alias("f"))
    return facts.observation_texts(w, "id", "d", {"h": "Hypertension", "s": "Smoking", "f": "Family_history_of_dementia"})


@query("R6", f"""WITH {people_sql('known_years', 'registered')} SELECT person_id, 'Years of education' AS observation_concept, registered AS observation_date, known_years::DOUBLE AS value_as_number FROM p WHERE known_years IS NOT NULL""")
def observation_numbers(t):
    return facts.observation_numbers(people(t, "known_years", "registered"), "person_id", "registered", "known_years")
