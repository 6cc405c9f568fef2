"""Registered queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge import extract
from parcelforge.functions import dates, jsonx, numbers, postcodes, predicates, text
from parcelforge.operators import archive, areas, clean, dedup, greedy, impute, ledger, reports, threads, timestamps
from parcelforge.plans import pipeline
from parcelforge.plans import sqltext as S
from parcelforge.runtime import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Day on which the rules that look at today stand.
AS_OF = "2026-06-30"
SENDERS = ["bralilnallrealestate.example", "@vintunwoldvale.example", "example.org"]
KEYWORDS = ["introduce", "best and final", "brochure", "heads of terms"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


OCC, INV, DEALS, MAILS = "raw_occupational_comps", "investment_comps", "deals", "email_summaries"
stop = ", ".join(S.q(w) for w in S.STOP_WORDS)
legal = "|".join(S.LEGAL_FORMS)


# --- scalar functions ------------------------------------------------------------------------------------------------------------------
@query(
    "name_keys",
    f"""select id, {S.name_key('tenant_name')} as tenant_name_key, {S.squeeze(S.sub(S.name_key('tenant_name'), rf'\b({legal})\b'))} as tenant,
    {S.strip(S.sub(S.sub(S.sub(S.name_key('unit_name'), r'\b0+([0-9])', r'\1'), r'\bunit\b\s*'), r'\bplot\b\s*'))} as unit,
    array_to_string(list_sort(list_distinct(list_filter({S.words('source_deal')}, lambda w: length(w) > 1 and w not in ({stop})))), ' ') as telling
    from raw_occupational_comps""",
)
def name_keys(spark, d):
    return table(spark, d, OCC).select("id", text.name_key("tenant_name").alias("tenant_name_key"), text.tenant_key("tenant_name").alias("tenant"), text.unit_key("unit_name").alias("unit"), F.array_join(F.array_sort(text.telling_words("source_deal")), " ").alias("telling"))


@query("mail_senders", r"""select gmail_message_id, lower(regexp_extract(sender, '@([\w.-]+)', 1)) as domain,
    lower(case when regexp_extract(sender, '<([^>]+)>', 1) <> '' then regexp_extract(sender, '<([^>]+)>', 1) when regexp_extract(sender, '([\w.+-]+@[\w.-]+)', 1) <> '' then regexp_extract(sender, '([\w.+-]+@[\w.-]+)', 1) else """ + S.strip("sender") + """ end) as address
    from email_summaries""")  # fmt: skip
def mail_senders(spark, d):
    return table(spark, d, MAILS).select("gmail_message_id", text.mail_domain("sender").alias("domain"), text.mail_address("sender").alias("address"))


@query("subject_names", "select gmail_message_id, " + S.strip(S.sub(S.strip(S.sub(S.strip(S.sub("coalesce(subject, '')", r"(?i)^(?:(?:re|fwd|fw)\s*:\s*)+")), r"(?i)\s*-\s*(?:subject to|revised|logistics warehous|investment opport)[^\n]*$")), r"\s*-\s+[A-Z]{1,2}\d[^\n]*$")) + " as asset_name from email_summaries")
def subject_names(spark, d):
    return threads.asset_names(table(spark, d, MAILS))


_marks = [r"(?im)^From:\s+[^\n]+?\n\s*Sent:\s+", r"(?im)^On\s+[^\n]{10,80}\s+wrote:\s*$", r"(?i)-{3,}\s*Original Message\s*-{3,}", r"_{10,}"]
_heads = ", ".join(
    f"case when {S.has('body_preview', m)} and {S.sub(S.get('body_preview', '(?ims)' + chr(92) + 'A(.*?)' + m.replace('(?im)', '').replace('(?i)', ''), 1), f'[{S.WS}]+$')} <> '' then {S.sub(S.get('body_preview', '(?ims)' + chr(92) + 'A(.*?)' + m.replace('(?im)', '').replace('(?i)', ''), 1), f'[{S.WS}]+$')} end"
    for m in _marks
)


@query("before_reply", f"select gmail_message_id, coalesce({_heads}, body_preview) as newest from email_summaries")
def before_reply(spark, d):
    return table(spark, d, MAILS).select("gmail_message_id", text.before_reply("body_preview").alias("newest"))


@query("iso_dates", "select id, " + ", ".join(f"{S.iso_date(c)} as {c}_iso" for c in clean.DATES) + " from raw_occupational_comps")
def iso_dates(spark, d):
    return table(spark, d, OCC).select("id", *(dates.iso_date(c).alias(f"{c}_iso") for c in clean.DATES))


_qn, _qo = r"^(\d{4})\s*[Qq]([1-4])", r"^[Qq]([1-4])\s*(\d{4})"
_qs = S.strip("quarter")


@query("quarters", f"""select row_no, {S.quarter_text('date', True)} as quarter_checked, {S.quarter_text('date', False)} as quarter_loose,
    case when {S.has(_qs, _qn)} then try_cast({S.get(_qs, _qn, 1)} as int) * 4 + try_cast({S.get(_qs, _qn, 2)} as int) when {S.has(_qs, _qo)} then try_cast({S.get(_qs, _qo, 2)} as int) * 4 + try_cast({S.get(_qs, _qo, 1)} as int) end as ordinal,
    regexp_matches({_qs}, '^([0-9]{{4}}\\s*[Qq][1-4]|[Qq][1-4]\\s*[-/]?\\s*[0-9]{{4}})$') as is_quarter,
    case when regexp_matches({S.strip('date')}, '^[0-9]{{1,2}}/[0-9]{{4}}$') then '01/' || lpad(regexp_extract({S.strip('date')}, '^([0-9]{{1,2}})/', 1), 2, '0') || '/' || right({S.strip('date')}, 4) else {S.strip('date')} end as month_first
    from investment_comps""")  # fmt: skip
def quarters(spark, d):
    return table(spark, d, INV).select("row_no", dates.quarter_text("date", True).alias("quarter_checked"), dates.quarter_text("date", False).alias("quarter_loose"), dates.quarter_ordinal("quarter").alias("ordinal"), dates.is_quarter("quarter").alias("is_quarter"), dates.first_of_month("date").alias("month_first"))


_dm, _iso = r"^(\d{1,2}/\d{1,2}/\d{4})$", r"^(\d{4}-\d{2}-\d{2})"
_sd = S.strip("date")


@query("parsed_days", f"""select deal_id, strftime(coalesce(try_strptime(nullif({S.get(_sd, _iso, 1)}, ''), '%Y-%m-%d'), try_strptime(nullif({S.get(_sd, _dm, 1)}, ''), '%d/%m/%Y'), timestamp '2026-06-30'), '%Y-%m-%d') as day,
    coalesce(strftime(coalesce(try_strptime(nullif({S.get('date', _dm, 1)}, ''), '%d/%m/%Y'), try_strptime(nullif({S.get('date', _iso, 1)}, ''), '%Y-%m-%d')), '%d/%m/%Y'), left(date, 10)) as shown from deals""")  # fmt: skip
def parsed_days(spark, d):
    return table(spark, d, DEALS).select("deal_id", F.date_format(dates.day_or("date", F.lit(AS_OF).cast("date")), "yyyy-MM-dd").alias("day"), dates.shown_date("date").alias("shown"))


_num = f"translate({S.get('area_quoted', r'[£]?[0-9][0-9.,]*')}, '£, ', '')"
_ok = f"case when {S.has(_num, r'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')} then try_cast({_num} as double) end"


@query("coerced_numbers", f"""select deal_id, {_ok} as as_float, nullif({_ok}, 0) as as_number, cast(trunc({_ok}) as int) as as_int,
    case when lower(coalesce({S.strip('town')}, '')) in ('null', 'none', 'n/a') then '' else coalesce({S.strip('town')}, '') end as town_text from deals""")  # fmt: skip
def coerced_numbers(spark, d):
    n = F.regexp_extract("area_quoted", r"[£]?[0-9][0-9.,]*", 0)
    return table(spark, d, DEALS).select("deal_id", numbers.to_float(n).alias("as_float"), numbers.to_number(n).alias("as_number"), numbers.to_int(n).alias("as_int"), numbers.clean_text("town").alias("town_text"))


@query("acre_notes", f"select id, {S.acres('notes')} as sqft from raw_occupational_comps where {S.acres('notes')} is not null")
def acre_notes(spark, d):
    return table(spark, d, OCC).select("id", numbers.acres_to_sqft("notes").alias("sqft")).where("sqft is not null")


@query("postcodes", f"""select id, {S.get('address', S.POSTCODE)} as found, {S.tidy_postcode('postcode')} as tidy, {S.spaced('upper(' + S.sub(S.get('address', S.POSTCODE), f'[{S.WS}]') + ')')} as archived,
    upper({S.get("string_split(address, ',')[-1]", S.POSTCODE)}) as in_last_part, {S.cut_postcode('address')} as without, {S.total_address('address', 'town', 'postcode')} as total_address from raw_occupational_comps""")  # fmt: skip
def postcode_forms(spark, d):
    return table(spark, d, OCC).select(
        "id", postcodes.find_postcode("address").alias("found"), postcodes.tidy_postcode("postcode").alias("tidy"), postcodes.archive_postcode("address").alias("archived"),
        postcodes.sheet_postcode("address").alias("in_last_part"), postcodes.cut_postcode("address").alias("without"), postcodes.total_address("address", "town", "postcode").alias("total_address"),
    )


_safe = lambda x: S.sub(S.squeeze(S.sub(x, r'[<>:"/\\|?*]')), r"[. ]+$")
_t, _n = f"coalesce({S.strip('town')}, '')", f"coalesce({S.strip('asset_name')}, '')"
_folder = f"case when {_t} <> '' and {_n} <> '' then {_t} || ', ' || {_n} when {_n} <> '' then {_n} when {_t} <> '' then {_t} else 'Unknown - ' || coalesce(nullif(agent, ''), 'No Agent') || ' - ' || coalesce(nullif(date, ''), 'No Date') end"


@query("folder_names", f"select deal_id, {S.sub('left(' + _safe(_folder) + ', 100)', f'[{S.WS}]+$')} as folder from deals")
def folder_names(spark, d):
    return table(spark, d, DEALS).select("deal_id", text.folder_name("town", "asset_name", "agent", "date").alias("folder"))


@query("file_names", f"""select gmail_message_id, f.u as attachment, {S.sub(S.sub('f.u', r'[<>:"/\\|?*]', '_'), r'^[. ]+|[. ]+$')} as safe from email_summaries, unnest(attachment_names) as f(u)""")
def file_names(spark, d):
    return table(spark, d, MAILS).select("gmail_message_id", F.explode("attachment_names").alias("attachment")).withColumn("safe", text.file_safe("attachment"))


@query("html_texts", r"""select gmail_message_id, """ + S.strip(S.sub(S.sub("replace(replace(replace(replace(" + S.sub(S.sub(S.sub("'<p class=x>' || coalesce(subject, '') || '<br/>A &amp; B&nbsp;&#39;</p><p>end'", r"(?i)<br\s*/?>", "\n"), r"(?i)<p[^>]*>", "\n\n"), r"<[^>]+>") + ", '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')", r"&#\d+;"), r"\n{3,}", "\n\n")) + " as body from email_summaries")
def html_texts(spark, d):
    html = F.concat(F.lit("<p class=x>"), F.coalesce("subject", F.lit("")), F.lit("<br/>A &amp; B&nbsp;&#39;</p><p>end"))
    return table(spark, d, MAILS).select("gmail_message_id", text.html_text(html).alias("body"))


@query("decoded_bodies", "select gmail_message_id, snippet as body from email_summaries")
def decoded_bodies(spark, d):
    data = F.translate(F.base64(F.encode("snippet", "UTF-8")), "+/\r\n", "-_")
    return table(spark, d, MAILS).select("gmail_message_id", text.decode_url64(data).alias("body"))


@query("reply_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def reply_json(spark, d):
    reply = F.concat(F.lit('Here is the "result" {as asked}:\n```json\n'), "props", F.lit("\n```\nDone."))
    got = jsonx.recover_object(reply)
    return table(spark, d, "events").select("event_id", F.get_json_object(got, "$.k").try_cast("bigint").alias("k"))


# --- predicates ---------------------------------------------------------------------------------------------------------------------------
_text = "lower(coalesce(subject, '') || ' ' || coalesce(body_preview, ''))"
_dom = "lower(sender_domain)"
_from = " or ".join(f"{_dom} = {S.q(x.lstrip('@'))} or ends_with({_dom}, {S.q('.' + x.lstrip('@'))})" for x in SENDERS)
_words = "list_filter([" + ", ".join(S.q(k) for k in KEYWORDS) + f"], lambda k: contains({_text}, k))"


@query("mail_filter", f"""select gmail_message_id, coalesce({_from}, false) as from_listed, array_to_string({_words}, ',') as keywords,
    coalesce(matched_label, false) or coalesce({_from}, false) or len({_words}) > 0 as any_filter, coalesce(matched_label, false) or (coalesce({_from}, false) and len({_words}) > 0) as all_filters from email_summaries""")  # fmt: skip
def mail_filter(spark, d):
    listed = predicates.from_domains("sender_domain", SENDERS)
    words = predicates.keywords_in(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body_preview", F.lit(""))), KEYWORDS)
    label = F.coalesce("matched_label", F.lit(False))
    tests = [listed, F.size(words) > 0]
    return table(spark, d, MAILS).select("gmail_message_id", listed.alias("from_listed"), F.array_join(words, ",").alias("keywords"), predicates.qualifies(label, tests).alias("any_filter"), predicates.qualifies(label, tests, need_all=True).alias("all_filters"))


_vac = f"({S.has('tenant_name', S.VACANT)} or ({S.blank('tenant_name')} and {S.has('notes', S.VACANT)}))"
_invf, _invl = S.has("notes", S.INVESTMENT), S.has("notes", S.INVESTMENT_LOOSE)
_av = f"({S.has('comp_date', S.AVAILABLE)} or {S.has('notes', S.AVAILABLE)})"


@query("letting_flags", f"select id, {_vac} as is_vacant, {_invf} as about_investment, {_invl} as about_investment_loose, {_av} as on_offer, rent_pa is null and rent_psf is null as no_rent from raw_occupational_comps")
def letting_flags(spark, d):
    return table(spark, d, OCC).select("id", predicates.vacant("tenant_name", "notes").alias("is_vacant"), predicates.about_investment("notes").alias("about_investment"), predicates.about_investment("notes", loose=True).alias("about_investment_loose"), predicates.available("comp_date", "notes").alias("on_offer"), (F.col("rent_pa").isNull() & F.col("rent_psf").isNull()).alias("no_rent"))


@query("junk_files", f"""select gmail_message_id, f.u as attachment, {S.has('f.u', S.IMAGE)} and (length(f.u) * 4096 < {S.SMALL_IMAGE} or {S.has('f.u', S.JUNK_IMAGE)}) as junk, {S.has('f.u', S.DOCUMENTS)} as document
    from email_summaries, unnest(attachment_names) as f(u)""")  # fmt: skip
def junk_files(spark, d):
    size = F.length("attachment") * 4096
    return table(spark, d, MAILS).select("gmail_message_id", F.explode("attachment_names").alias("attachment")).select("gmail_message_id", "attachment", predicates.junk_image("attachment", size, F.lit(False)).alias("junk"), predicates.is_document("attachment").alias("document"))


@query("stub_names", "select gmail_message_id, " + " or ".join(f"contains(lower(coalesce(subject, '')), {S.q(w)})" for w in S.STUB_WORDS) + " as disqualified from email_summaries")
def stub_names(spark, d):
    return table(spark, d, MAILS).select("gmail_message_id", predicates.stub_name(F.coalesce("subject", F.lit(""))).alias("disqualified"))


# --- joins ------------------------------------------------------------------------------------------------------------------------------------
@query("unseen_mails", "select gmail_message_id, subject from email_summaries m where not exists (select 1 from deals d where d.gmail_message_id = m.gmail_message_id)")
def unseen_mails(spark, d):
    return ledger.unseen(table(spark, d, MAILS), table(spark, d, DEALS), ["gmail_message_id"]).select("gmail_message_id", "subject")


@query("classified_mails", """select m.gmail_message_id, coalesce(d.n, 0) as deals, coalesce(d.reason, 'Thread member') as reason from (select distinct gmail_message_id from email_summaries) m
    left join (select gmail_message_id, count(*) as n, min(classification) as reason from deals group by 1) d using (gmail_message_id)""")  # fmt: skip
def classified_mails(spark, d):
    n = table(spark, d, DEALS).groupBy("gmail_message_id").agg(F.count("*").alias("n"), F.min("classification").alias("reason"))
    return table(spark, d, MAILS).select("gmail_message_id").distinct().join(n, "gmail_message_id", "left").select("gmail_message_id", F.coalesce("n", F.lit(0)).alias("deals"), F.coalesce("reason", F.lit("Thread member")).alias("reason"))


_oc = S.get(S.tidy_postcode("postcode"), r"^([A-Z]{1,2}\d[A-Z\d]?) \d[A-Z]{2}$", 1)


@query("postcode_towns", f"select o.id, p.place_town from (select id, {_oc} as outcode from raw_occupational_comps) o left join (select upper(outcode) as outcode, min(name) as place_town from place_dim group by 1) p using (outcode)")
def postcode_towns(spark, d):
    o = table(spark, d, OCC).select("id", F.regexp_extract(postcodes.tidy_postcode("postcode"), r"^([A-Z]{1,2}\d[A-Z\d]?) \d[A-Z]{2}$", 1).alias("_outcode"))
    return o.join(clean.outcode_towns(table(spark, d, "place_dim")), "_outcode", "left").select("id", F.col("_place_town").alias("place_town"))


@query("deal_name_towns", f"""with parts as (select id, i as pos, lower({S.strip("string_split(source_deal, ',')[i]")}) as part from raw_occupational_comps, range(1, 20) r(i) where i <= len(string_split(source_deal, ',')) and {S.place_like(S.strip("string_split(source_deal, ',')[i]"))}),
    names as (select lower(candidate) as part, min(name) as part_town from place_dim where local_type in ({", ".join(S.q(x) for x in S.SETTLEMENTS)}) group by 1)
    select id, arg_min(part_town, pos) as town from parts join names using (part) group by id""")  # fmt: skip
def deal_name_towns(spark, d):
    parts = table(spark, d, OCC).select("id", F.posexplode(F.transform(F.split("source_deal", ","), text.strip)).alias("pos", "p")).withColumn("_part", F.lower("p")).where(clean.place_like(F.col("p")))
    return parts.join(clean.place_names(table(spark, d, "place_dim")), "_part").groupBy("id").agg(F.min_by("_part_town", "pos").alias("town"))


_links = """with k as (select id, rent_pa, rent_psf, {key} as k from raw_occupational_comps where not ({flags}))
    select a.id, count(*) as links, min(b.id) as first_id from k a join k b on a.k = b.k and a.k <> '' and a.id <> b.id and ({pa} or (a.rent_pa is null and b.rent_pa is null and {psf})) group by a.id"""
_flags = f"{_vac} or {_invf} or (rent_pa is null and rent_psf is null)"
_rent = {"pa": S.close("a.rent_pa", "b.rent_pa", S.RENT), "psf": S.close("a.rent_psf", "b.rent_psf", S.RENT), "flags": _flags}


def _link_counts(spark, d, key):
    from parcelforge.operators.blocking import band_pairs

    rows = dedup.flagged(table(spark, d, OCC)).where("not (is_vacant or is_investment or no_rent)")
    p = band_pairs(rows, "id", [], "rent_pa", "rent_psf", dedup.RENT, [key])
    both = p.select(F.col("id_a").alias("id"), F.col("id_b").alias("o")).union(p.select("id_b", "id_a"))
    return both.groupBy("id").agg(F.count("*").alias("links"), F.min("o").alias("first_id"))


@query("tenant_rent_links", _links.format(key=S.squeeze(S.sub(S.name_key("coalesce(tenant_name, '')"), rf"\b({legal})\b")), **_rent))
def tenant_rent_links(spark, d):
    return _link_counts(spark, d, "tenant")


@query("unit_rent_links", _links.format(key=S.strip(S.sub(S.sub(S.sub(S.name_key("coalesce(unit_name, '')"), r"\b0+([0-9])", r"\1"), r"\bunit\b\s*"), r"\bplot\b\s*")), **_rent))
def unit_rent_links(spark, d):
    return _link_counts(spark, d, "unit")


@query("deal_lookup")
def deal_lookup(spark, d):
    """The first brochure deal that each mail deal matches by the five tiers."""
    cols = lambda t, k: table(spark, d, t).select(F.col(k).alias("id"), F.coalesce("asset_name", F.lit("")).alias("name"), F.coalesce("town", F.lit("")).alias("town"), F.coalesce("postcode", F.lit("")).alias("postcode"))
    return dedup.lookup_deals(cols(DEALS, "deal_id"), cols("brochure_deals", "brochure_deal_id"))


@query("archive_folders")
def archive_folders(spark, d):
    deals = table(spark, d, DEALS).select("deal_id", text.folder_name("town", "asset_name", "agent", "date").alias("folder_name"), "town", "postcode")
    folders = table(spark, d, "brochure_deals").select(text.folder_name("town", "asset_name", "agent", "date").alias("folder"), "town", "postcode").distinct()
    return ledger.folder_lookup(deals, folders)


# --- aggregates and windows -------------------------------------------------------------------------------------------------------------------
_one = "(select gmail_message_id, subject, sender_domain, date, body_preview, attachment_names, matched_keywords, matched_sender, matched_label, coalesce(nullif(trim(thread_id), ''), gmail_message_id) as tid from email_summaries where trim(gmail_message_id) <> '')"


@query("thread_summary", f"""with m as (select tid, gmail_message_id, min(date) as date, min(subject) as subject, min(sender_domain) as dom, bool_or(matched_sender) as ms, bool_or(matched_label) as ml, max(len(attachment_names)) as files from {_one} group by 1, 2)
    select tid as thread_id, count(*) as email_count, min(date) as earliest_date, max(date) as latest_date, coalesce(array_to_string(list_sort(list_distinct(list(dom) filter (where dom is not null))), ','), '') as domains, bool_or(ms) as matched_sender, bool_or(ml) as matched_label,
    cast(sum(files) as bigint) as files from m group by 1""")  # fmt: skip
def thread_summary(spark, d):
    rows = table(spark, d, MAILS).where("trim(gmail_message_id) <> ''").withColumn("tid", threads.thread_key())
    one = rows.groupBy("tid", "gmail_message_id").agg(
        F.min("date").alias("date"), F.min("subject").alias("subject"), F.min("sender_domain").alias("sender_domain"), F.bool_or("matched_sender").alias("matched_sender"), F.bool_or("matched_label").alias("matched_label"),
        F.max(F.size("attachment_names")).alias("files"), F.first("attachment_names").alias("attachment_names"), F.first("matched_keywords").alias("matched_keywords"),
    )
    files = one.groupBy(F.col("tid").alias("thread_id")).agg(F.sum("files").alias("files"))
    out = threads.group_threads(one.withColumnRenamed("tid", "thread_id"))
    return out.join(files, "thread_id").select("thread_id", "email_count", F.col("earliest_date"), "latest_date", F.array_join(F.array_sort("all_sender_domains"), ",").alias("domains"), "matched_sender", "matched_label", "files")


@query("best_mails", f"""with m as (select gmail_message_id, tid, date, coalesce(len(attachment_names), 0) * 3 + coalesce(length(body_preview), 0) / 1000 as s from {_one}),
    r as (select *, row_number() over (partition by tid order by s desc, date nulls first, gmail_message_id) as n from m) select tid as thread_id, gmail_message_id from r where n = 1""")  # fmt: skip
def best_mails(spark, d):
    return threads.best_mails(table(spark, d, MAILS).where("trim(gmail_message_id) <> ''")).select("thread_id", "gmail_message_id")


@query("mail_labels", f"""with m as (select tid, gmail_message_id, min(date) as date from {_one} group by 1, 2), r as (select *, row_number() over (partition by tid order by date nulls first, gmail_message_id) as position, count(*) over (partition by tid) as of from m)
    select gmail_message_id, position, of, 'Email ' || position || ' of ' || of || case when position = 1 and of > 1 then ' (oldest)' when position = of and of > 1 then ' (newest)' else '' end as label from r""")  # fmt: skip
def mail_labels(spark, d):
    rows = table(spark, d, MAILS).where("trim(gmail_message_id) <> ''").withColumn("thread_id", threads.thread_key())
    return threads.mail_labels(rows.groupBy("thread_id", "gmail_message_id").agg(F.min("date").alias("date")))


@query("event_stats", "select count(*) as total, count(*) filter (where event_type = 'click') as introductions, count(*) filter (where event_type = 'view') as skipped, count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 10) as pipeline_rows from events")
def event_stats(spark, d):
    e = table(spark, d, "events")
    rows = e.select((F.col("event_type") == "click").alias("is_introduction"), F.when(F.col("event_type") == "view", "skipped").otherwise(F.col("event_type")).alias("status"), (F.col("value") > 10).alias("pipeline_row_added"))
    return ledger.processing_stats(rows)


@query("domain_histogram", "select sender_domain, count(*) as mails from email_summaries group by 1 order by mails desc, sender_domain limit 10")
def domain_histogram(spark, d):
    return ledger.recent(table(spark, d, MAILS).groupBy("sender_domain").agg(F.count("*").alias("mails")), [F.desc("mails"), F.asc_nulls_last("sender_domain")], 10)


@query("mail_counts", "select count(*) as mails, count(distinct sender_domain) as domains, count(*) filter (where len(attachment_names) > 0) as with_files from email_summaries")
def mail_counts(spark, d):
    return table(spark, d, MAILS).agg(F.count("*").alias("mails"), F.count_distinct("sender_domain").alias("domains"), F.count_if(F.size("attachment_names") > 0).alias("with_files"))


@query("recent_events", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 20")
def recent_events(spark, d):
    return ledger.recent(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("file_groups", """select doc_kind as name, n_chars as size, min(lpad(cast(doc_id as varchar), 12, '0')) as path, count(distinct source) as deals,
    arg_min(source, lpad(cast(doc_id as varchar), 12, '0')) || case when count(distinct source) > 1 then ' (+' || (count(distinct source) - 1) || ' more)' else '' end as label from documents group by 1, 2""")  # fmt: skip
def file_groups(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_kind").alias("name"), F.col("n_chars").alias("size"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("source").alias("deal"))
    return ledger.first_by_file(files).select("name", "size", "path", F.size("deals").cast("bigint").alias("deals"), "label")


@query("order_visits", """with l as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, coalesce(date_diff('day', lag(cast(o_orderdate as date)) over w, cast(o_orderdate as date)) > 90, true) as fresh from orders window w as (partition by o_custkey order by cast(o_orderdate as date), o_orderkey))
    select o_orderkey, cast(sum(fresh::int) over (partition by o_custkey order by day, o_orderkey) as bigint) as visit from l""")  # fmt: skip
def order_visits(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("date").alias("day"))
    return ledger.visits(o, "o_custkey", "day").select(F.col("row_id").alias("o_orderkey"), "visit")


@query("latest_events", "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_events(spark, d):
    return ledger.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("upserted_deals", "select gmail_message_id, asset_name, seq from (select gmail_message_id, asset_name, brochure_deal_id as seq, row_number() over (partition by gmail_message_id order by n desc, brochure_deal_id desc) as r from (select lower(asset_name) as gmail_message_id, asset_name, deal_id as brochure_deal_id, 0 as n from deals union all select lower(asset_name), asset_name, brochure_deal_id, 1 from brochure_deals)) where r = 1")
def upserted_deals(spark, d):
    cols = lambda t, k: table(spark, d, t).select(F.lower("asset_name").alias("gmail_message_id"), "asset_name", F.col(k).alias("seq"))
    return ledger.upsert(cols(DEALS, "deal_id"), cols("brochure_deals", "brochure_deal_id"), ["gmail_message_id"])


@query("unique_comps", """with k as (select *, source_deal is null or entry_type is null or tenant_name is null or address is null or unit_name is null or rent_pa is null as free from raw_occupational_comps)
    select id from (select id, free, row_number() over (partition by free, source_deal, entry_type, tenant_name, address, unit_name, rent_pa order by id desc) as n from k) where free or n = 1""")  # fmt: skip
def unique_comps(spark, d):
    return ledger.unique_rows(table(spark, d, OCC), ["source_deal", "entry_type", "tenant_name", "address", "unit_name", "rent_pa"], [F.desc("id")]).select("id")


@query("numbered_files", r"""with f as (select gmail_message_id, a.u as name, row_number() over () as k from (select distinct gmail_message_id, attachment_names from email_summaries), unnest(attachment_names) a(u)),
    g as (select distinct sender_domain as folder, name, m.gmail_message_id from email_summaries m join f using (gmail_message_id)), r as (select *, row_number() over (partition by folder, lower(name) order by gmail_message_id, name) as n from g)
    select folder, name, gmail_message_id, case when n = 1 then name else left(name, length(name) - length(regexp_extract(name, '(\.[^.]+)$', 1))) || ' (' || n || ')' || regexp_extract(name, '(\.[^.]+)$', 1) end as free_name from r""")  # fmt: skip
def numbered_files(spark, d):
    rows = table(spark, d, MAILS).select(F.col("sender_domain").alias("folder"), F.explode("attachment_names").alias("name"), "gmail_message_id").distinct()
    return ledger.numbered(rows, "folder", "name", [F.col("gmail_message_id"), F.col("name")])


_fields = ["town", "postcode", "notes"]


def _fill_sql(policy):
    order = "id" if policy == "first" else "id desc"
    def cell(f):
        ok = f"not {S.blank(f)}"
        return f"coalesce(max({f}) filter (where id = k and {ok}), {'arg_min' if policy == 'first' else 'arg_max'}({f}, id) filter (where id <> k and {ok}), max({f}) filter (where id = k)) as {f}"
    nums = [f"coalesce(max({f}) filter (where id = k), {'arg_min' if policy == 'first' else 'arg_max'}({f}, id) filter (where id <> k and {f} is not null)) as {f}" for f in ("size_sqft", "rent_pa")]
    return f"with g as (select *, min(id) over (partition by lower(source_deal), lower(tenant_name), lower(unit_name)) as k from raw_occupational_comps) select k as id, {', '.join([cell(f) for f in _fields] + nums)}, count(*) - 1 as merged from g group by k"


def _fill(spark, d, policy):
    from pyspark.sql import Window

    rows = table(spark, d, OCC)
    # rows of one deal, tenant and unit; the smallest id is kept
    w = Window.partitionBy(F.lower("source_deal"), F.lower("tenant_name"), F.lower("unit_name"))
    groups = rows.select("id", F.min("id").over(w).alias("kept_id"))
    return greedy.fill_blanks(rows.select("id", *_fields, "size_sqft", "rent_pa"), groups, [*_fields, "size_sqft", "rent_pa"], policy)


QUERIES["fill_first"] = lambda spark, d: _fill(spark, d, "first")
QUERIES["fill_last"] = lambda spark, d: _fill(spark, d, "last")
ORACLE["fill_first"], ORACLE["fill_last"] = _fill_sql("first"), _fill_sql("last")


_some = lambda c, none: f"nullif({c}, {none})"


@query("merged_deals", f"""with m as (select lower(asset_name) as k, arg_min(struct_pack(date := date, agent := agent, asset_name := asset_name, town := town, rent_pa := rent_pa, confidence := confidence, raw_source := raw_source), deal_id) as v from deals where asset_name is not null group by 1),
    b as (select lower(asset_name) as k, arg_min(struct_pack(asset_name := asset_name, town := town, rent_pa := rent_pa, confidence := confidence), brochure_deal_id) as v from brochure_deals where asset_name is not null group by 1)
    select k, m.v.date as date, m.v.agent as agent, coalesce(nullif(m.v.asset_name, ''), nullif(b.v.asset_name, '')) as asset_name, coalesce(nullif(b.v.town, ''), nullif(m.v.town, '')) as town, coalesce(nullif(b.v.rent_pa, 0), nullif(m.v.rent_pa, 0)) as rent_pa,
    greatest(m.v.confidence, b.v.confidence) as confidence from m join b using (k)""")  # fmt: skip
def merged_deals(spark, d):
    def first(t, key):
        rows = table(spark, d, t).where("asset_name is not null")
        cols = [c for c in rows.columns if c not in (key, "gmail_message_id", "file_path", "area_quoted")]
        return rows.groupBy(F.lower("asset_name").alias("k")).agg(F.min_by(F.struct(*cols), key).alias("v")).select("k", "v.*")

    return ledger.merge_sides(first(DEALS, "deal_id"), first("brochure_deals", "brochure_deal_id"), "k").select("k", "date", "agent", "asset_name", "town", "rent_pa", "confidence")


# --- cleaning and duplicates -------------------------------------------------------------------------------------------------------------------
_z = lambda c: f"nullif({c}, 0)"


@query("inv_clean", f"""with a as (select row_no, case when {S.blank('quarter')} then {S.quarter_text('date', True)} else quarter end as quarter, {_z('area_sqft')} as a0, {_z('rent_pa')} as p0, {_z('rent_psf')} as f0, {_z('price')} as price, {_z('yield_niy')} as y, {_z('capval_psf')} as c0 from investment_comps where address <> ''),
    r as (select *, coalesce(p0, nullif(round(price * 1.068 * y, 2), 0)) as p2 from a), b as (select *, coalesce(p2, nullif(round(f0 * a0, 2), 0)) as p1 from r), c as (select *, coalesce(f0, nullif(round(p1 / a0, 2), 0)) as f1 from b), e as (select *, coalesce(a0, round(p1 / f1, 0)) as a1 from c)
    select row_no, quarter, p1 as rent_pa, f1 as rent_psf, a1 as area_sqft, coalesce(c0, round(price / a1, 2)) as capval_psf from e""")  # fmt: skip
def inv_clean(spark, d):
    return clean.clean_investment(table(spark, d, INV)).select("row_no", "quarter", "rent_pa", "rent_psf", "area_sqft", "capval_psf")


@query("occ_clean", S.cleaned_occupational("2026-06-30") + S.LETTINGS_ONLY)
def occ_clean(spark, d):
    """The cleaned lettings: every rule, then the three filters."""
    return clean.lettings_only(clean.clean_occupational(table(spark, d, OCC), table(spark, d, "place_dim"), AS_OF))


@query("occ_clean_counts", S.cleaned_occupational("2026-06-30") + S.FILTER_COUNTS)
def occ_clean_counts(spark, d):
    return clean.filter_counts(clean.clean_occupational(table(spark, d, OCC), table(spark, d, "place_dim"), AS_OF))


@query("occ_dedup")
def occ_dedup(spark, d):
    """Each letting row and the earlier row that it duplicates, if any, with the flags that exempt rows."""
    return dedup.dedup_lettings(table(spark, d, OCC))


@query("occ_dedup_summary")
def occ_dedup_summary(spark, d):
    return dedup.dedup_summary(dedup.dedup_lettings(table(spark, d, OCC)))


@query("inv_dedup")
def inv_dedup(spark, d):
    inv = table(spark, d, INV)
    return greedy.first_wins(inv.select(F.col("row_no").alias("id")), dedup.investment_pairs(inv))


@query("insert_actions")
def insert_actions(spark, d):
    """Comparables put into a table of tenancies: what is inserted and what duplicates which row."""
    comps = table(spark, d, OCC)
    kind = F.coalesce(F.nullif(text.strip("entry_type"), F.lit("")), F.lit("tenancy"))
    return dedup.insert_batch(comps.where(kind != "comparable"), comps.where(kind == "comparable"))


@query("property_groups")
def property_groups(spark, d):
    t = threads.group_threads(threads.one_delivery(table(spark, d, MAILS)))
    t = t.select("thread_id", threads.newest_first().alias("pos"), text.subject_name("latest_subject").alias("name"), F.lit("").alias("town"), threads.thread_score().alias("score"), F.col("all_sender_domains").alias("domains"))
    return threads.group_properties(t)


@query("distinct_deals")
def distinct_deals(spark, d):
    """Deals and the earlier deal that each of them repeats, if any."""
    return pipeline.distinct_deals(table(spark, d, DEALS))


@query("archive_plan", f"""with d as (select deal_id, {S.sub('left(' + _safe(_folder) + ', 100)', f'[{S.WS}]+$')} as base, coalesce(try_strptime(nullif({S.get(_sd, _iso, 1)}, ''), '%Y-%m-%d'), try_strptime(nullif({S.get(_sd, _dm, 1)}, ''), '%d/%m/%Y'), timestamp '2026-06-30') as day, agent from deals),
    v as (select *, sum(fresh) over (partition by base order by day, deal_id) as visit from (select *, case when date_diff('day', lag(day) over w, day) <= 90 then 0 else 1 end as fresh from d window w as (partition by base order by day, deal_id))),
    o as (select *, min(day) over (partition by base, visit) as opened from v),
    n as (select deal_id, base, case when visit = 1 then base else base || ' (' || year(opened) || ' Q' || quarter(opened) || ')' end as folder, {S.sub('left(' + _safe("strftime(day, '%Y-%m-%d') || ' - ' || (case when " + S.blank('agent') + " then 'Unknown' else " + S.strip('agent') + " end)") + ', 100)', f'[{S.WS}]+$')} as dated from o),
    r as (select *, row_number() over (partition by folder, lower(dated) order by deal_id) as k from n)
    select deal_id, base, folder, dated || case when k > 1 then ' (' || k || ')' else '' end as subfolder from r""")  # fmt: skip
def archive_plan(spark, d):
    return archive.archive_plan(table(spark, d, DEALS), AS_OF)


@query("clean_lettings")
def clean_lettings(spark, d):
    """Lettings deduplicated, merged (later duplicates first) and cleaned."""
    return pipeline.clean_tables(table(spark, d, OCC), table(spark, d, INV), table(spark, d, "place_dim"), AS_OF)["lettings"]


@query("filled_locations", f"""with u as (select o.*, p.place_town as town_found from raw_occupational_comps o left join (select id, {_oc} as outcode from raw_occupational_comps) k using (id) left join (select upper(outcode) as outcode, min(name) as place_town from place_dim group by 1) p using (outcode))
    select id, coalesce(case when not {S.blank('town')} then town end, town_found, town) as town from u""")  # fmt: skip
def filled_locations(spark, d):
    """Towns filled from the postcode's outcode where they are blank; what stands is never overwritten."""
    o = table(spark, d, OCC)
    found = QUERIES["postcode_towns"](spark, d).select("id", F.lit(None).cast("string").alias("address"), F.col("place_town").alias("town"), F.lit(None).cast("string").alias("postcode"))
    return clean.fill_location(o.select("id", "address", "town", "postcode"), found, ["id"])[0].select("id", "town")


@query("replayed_records", "select event_id, 0 as pos, 'Unit ' || event_type as unit_name, case when value <> 0 then value else 0 end as rent_pa from events")
def replayed_records(spark, d):
    """Records out of recorded model replies: one comparable per event, its number quoted and with a pound sign."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_key"), "event_id", F.concat(F.lit('Sure!\n```json\n{"comparables": [{"unit_name": "Unit '), "event_type", F.lit('", "rent_pa": "£'), F.col("value").cast("string"), F.lit('"}]}\n```')).alias("response"))
    replies = extract.ReplayExtractor(e.select("request_key", "response")).ask(e.select("request_key", "event_id"))
    return extract.records(replies, "event_id", "unit_name STRING, rent_pa DOUBLE")


# --- more of the flow --------------------------------------------------------------------------------------------------------------------------
_model = lambda x: " or ".join(f"contains(lower({x}), {S.q(w)})" for w in S.MODEL_WORDS)


@query("brochure_files", f"select gmail_message_id, f.u as attachment, {S.has('f.u', S.DOCUMENTS)} and not ({_model('f.u')}) as brochure, {_model('f.u')} as model, {S.has('f.u', S.DOCUMENTS[:-3] + '|pptx|ppt)$')} as kept from email_summaries, unnest(attachment_names) as f(u)")
def brochure_files(spark, d):
    """Attachments: which are brochures to parse, which are financial models, which are kept at all."""
    files = table(spark, d, MAILS).select("gmail_message_id", F.explode("attachment_names").alias("attachment"))
    return files.select("gmail_message_id", "attachment", (predicates.is_document("attachment") & ~predicates.financial_model("attachment")).alias("brochure"), predicates.financial_model("attachment").alias("model"), predicates.is_attachment("attachment").alias("kept"))


_stub = " or ".join(f"contains(lower(coalesce(asset_name, '')), {S.q(w)})" for w in S.STUB_WORDS)
_subject = ORACLE["subject_names"].removeprefix("select gmail_message_id, ").removesuffix(" as asset_name from email_summaries")


@query("mail_routes", f"""with m as (select gmail_message_id, bool_or(matched_label) as intro, bool_or(has_attachments) as files, min({_subject}) as asset_name from email_summaries group by 1), n as (select gmail_message_id, count(*) as deals from deals group by 1)
    select m.gmail_message_id, case when coalesce(n.deals, 0) > 0 then 'deals' when not coalesce(intro, false) and not coalesce(files, false) then 'not introduction' when not coalesce(files, false) then 'error' when {_stub} then 'not a stub' else 'stub' end as route from m left join n using (gmail_message_id)""")  # fmt: skip
def mail_routes(spark, d):
    """What becomes of each message, by its deals, label and files."""
    m = table(spark, d, MAILS).groupBy("gmail_message_id").agg(F.bool_or("matched_label").alias("intro"), F.bool_or("has_attachments").alias("files"), F.min(text.subject_name("subject")).alias("name"))
    n = table(spark, d, DEALS).groupBy("gmail_message_id").agg(F.count("*").alias("deals"))
    return m.join(n, "gmail_message_id", "left").select("gmail_message_id", predicates.route(F.col("deals"), F.col("intro"), F.col("files"), F.col("name")).alias("route"))


@query("scan_rows", """select gmail_message_id, """ + f"coalesce(strftime(coalesce(try_strptime(nullif({S.get('date', _dm, 1)}, ''), '%d/%m/%Y'), try_strptime(nullif({S.get('date', _iso, 1)}, ''), '%Y-%m-%d')), '%d/%m/%Y'), left(date, 10)) as day," + """
    case when length(sender) > 35 then left(sender, 33) || '..' else sender end as sender, case when length(subject) > 50 then left(subject, 48) || '..' else subject end as subject, case when len(attachment_names) > 0 then left(array_to_string(attachment_names, ', '), 18) else '-' end as files,
    coalesce(nullif(concat_ws(' + ', case when matched_label then 'label' end, case when matched_sender then 'sender' end, case when len(matched_keywords) > 0 then 'kw:' || array_to_string(matched_keywords[1:3], ',') end), ''), 'query') as reason from email_summaries""")  # fmt: skip
def scan_rows(spark, d):
    return reports.scan_table(table(spark, d, MAILS))


@query("unseen_files", "select file_path, brochure_deal_id from brochure_deals b where not exists (select 1 from raw_occupational_comps o where o.source_file_path = b.file_path and length(o.source_file_path) = length(b.file_path))")
def unseen_files(spark, d):
    """Files that no earlier run has read in this size (here the length of the path stands for it)."""
    new = table(spark, d, "brochure_deals").select("file_path", F.length("file_path").alias("size"), "brochure_deal_id")
    return ledger.unseen(new, table(spark, d, OCC).select(F.col("source_file_path").alias("file_path"), F.length("source_file_path").alias("size")), ["file_path", "size"]).select("file_path", "brochure_deal_id")


@query("thread_report", """with r as (select coalesce(nullif(trim(thread_id), ''), gmail_message_id) as thread_id, case when matched_label then 'processed' when has_attachments then 'error' else 'skipped' end as status, matched_label as intro, len(attachment_names) as files, subject from email_summaries)
    select count(*) as threads_processed, count(*) filter (where status = 'processed') as successfully_processed, count(*) filter (where intro) as introductions, count(*) filter (where not coalesce(intro, false)) as not_introductions, cast(sum(files) as bigint) as pipeline_rows_added,
    cast(sum(files) as bigint) as archived, cast(0 as bigint) as brochures_parsed, cast(0 as bigint) as investment_comps_added, cast(0 as bigint) as occupational_comps_added, count(*) filter (where status = 'error') as errors, greatest(count(*) filter (where status = 'error') - 10, 0) as more_errors from r""")  # fmt: skip
def thread_report(spark, d):
    """The counters of a run in which labelled mails were processed and other mails with files failed."""
    m = table(spark, d, MAILS)
    status = F.when(F.col("matched_label"), "processed").when(F.col("has_attachments"), "error").otherwise("skipped")
    files, none = F.size("attachment_names"), F.lit(0)
    rows = m.select(threads.thread_key().alias("thread_id"), status.alias("status"), F.col("matched_label").alias("is_introduction"), files.alias("pipeline_rows_added"), files.alias("archived"), none.alias("brochures_parsed"), none.alias("investment_comps"), none.alias("occupational_comps"), F.col("subject").alias("error_message"))
    return reports.run_report(rows).drop("error_details")


@query("kept_rows", "select row_no from investment_comps where row_no < (select coalesce(min(row_no), 1e18) from investment_comps where coalesce(address, '') <> '' and coalesce(date, '') = '')")
def kept_rows(spark, d):
    """Rows of the sheet that an earlier run did not write."""
    inv = table(spark, d, INV).select(F.col("row_no").alias("row"), "address", "date")
    return reports.without_pipeline_rows(inv).select(F.col("row").alias("row_no"))


@query("folder_renames", f"""with b as (select lower(asset_name) as k, min({S.sub('left(' + _safe(_folder) + ', 100)', f'[{S.WS}]+$')}) as ideal from brochure_deals where asset_name is not null group by 1),
    f as (select distinct {S.strip('d.asset_name')} as folder, b.ideal from deals d join b on lower(d.asset_name) = b.k)
    select min(folder) as folder, ideal from f where ideal <> '' and ideal <> folder and (length(ideal) > length(folder) or (contains(ideal, ',') and not contains(folder, ','))) and ideal not in (select folder from f) group by ideal""")  # fmt: skip
def folder_renames(spark, d):
    """Folders named by a mail's deal for which its brochure has a better name."""
    b = table(spark, d, "brochure_deals").where("asset_name is not null").groupBy(F.lower("asset_name").alias("k")).agg(F.min(text.folder_name("town", "asset_name", "agent", "date")).alias("ideal"))
    f = table(spark, d, DEALS).select(F.lower("asset_name").alias("k"), text.strip("asset_name").alias("folder")).join(b, "k").select("folder", "ideal").distinct()
    return reports.renames(f)


_addr = "coalesce(" + S.strip("address") + ", '')"
_town = "coalesce(" + S.strip("town") + ", '')"


@query("open_locations", f"""{S.cleaned_occupational('2026-06-30')} select {_addr} as address, {_town} as town, count(*) as rows from z where {S.blank('postcode')} and ({_addr} <> '' or {_town} <> '') group by 1, 2""")
def open_locations(spark, d):
    """The different locations that still lack a postcode after cleaning."""
    cleaned = clean.clean_occupational(table(spark, d, OCC), table(spark, d, "place_dim"), AS_OF)
    return clean.open_locations(cleaned)[0].select("address", "town", "rows")


@query("inferred_postcodes", f"""{S.cleaned_occupational('2026-06-30')}, asked as (select id, town, changes, {_addr} as a, {_town} as t, {S.blank('postcode')} and ({_addr} <> '' or {_town} <> '') and contains({_addr}, 'a') as asked from z),
    least as (select min(outcode) as oc from place_dim), known as (select min(name) as place from place_dim, least where upper(outcode) = upper(oc))
    select id, upper(oc) || ' 9ZZ' as postcode, case when {S.blank('town')} then place else town end as town from asked, least, known where asked.asked""")  # fmt: skip
def inferred_postcodes(spark, d):
    """Rows whose postcode an external model supplied, here a recorded one that knows the first outcode for addresses with an ``a`` and nothing else."""
    places = table(spark, d, "place_dim")
    cleaned = cut(clean.clean_occupational(table(spark, d, OCC), places, AS_OF))
    requests, rows = clean.open_locations(cleaned)
    first = F.broadcast(places.agg(F.upper(F.min("outcode")).alias("oc")))  # one row
    replies = requests.join(first).select("request_key", F.when(F.contains("address", F.lit("a")), F.concat("oc", F.lit(" 9zz"))).otherwise("no idea").alias("response"))
    out = clean.infer_postcodes(cleaned, places, extract.ReplayExtractor(replies))
    return out.join(rows.select("id"), "id").where(~text.blank("postcode")).select("id", "postcode", "town")


_yes = lambda c: f"case when {c} then 'Yes' else 'No' end"
_a, _p = "coalesce(address, '')", "coalesce(postcode, '')"
_wp = S.sub(f"case when {_p} <> '' and not contains({_a}, {_p}) then {_a} || ', ' || {_p} else {_a} end", r"^[, ]+|[, ]+$")


@query("sheet_rows", f"""select deal_id, coalesce(strftime(try_strptime(nullif({S.get(_sd, _dm, 1)}, ''), '%d/%m/%Y'), '%Y-%m-%d'), date) as date, {_wp} as address, net_yield / 100 as net_yield, reversionary_yield / 100 as reversionary_yield, 'New' as status, 'No' as considered,
    {_yes('confidence > 0.5')} as brochure_stored, 'No' as brochure_scraped, nullif(raw_source, '') as comment from deals where {S.name_key("coalesce(asset_name, '')")} = '' or deal_id in (select min(deal_id) from deals)""")  # fmt: skip
def sheet_rows(spark, d):
    """Rows that deals without name, and the first deal, add to an empty sheet: nothing is there for them to match."""
    deals = table(spark, d, DEALS)
    first = F.broadcast(deals.agg(F.min("deal_id").alias("_first")))  # one row
    new = deals.join(first).where((text.name_key(F.coalesce("asset_name", F.lit(""))) == "") | (F.col("deal_id") == F.col("_first")))
    new = new.withColumns({"has_brochure": F.col("confidence") > 0.5, "brochure_scraped": F.lit(False), "comment": F.col("raw_source"), "also_introduced_by": F.lit("")})
    sheet = spark.createDataFrame([], "row bigint, asset_name string, town string, address string")
    return dedup.append_deals(sheet, new).select("deal_id", "date", "address", "net_yield", "reversionary_yield", "status", "considered", "brochure_stored", "brochure_scraped", "comment")


@query("appended_deals")
def appended_deals(spark, d):
    """Rows that the deals of mails add to a sheet of the brochures' deals."""
    sheet = table(spark, d, "brochure_deals").select(F.col("brochure_deal_id").alias("row"), "asset_name", "town", postcodes.with_postcode("address", "postcode").alias("address"))
    new = table(spark, d, DEALS).withColumns({"has_brochure": F.lit(False), "brochure_scraped": F.lit(False), "comment": F.lit(""), "also_introduced_by": F.lit("")})
    return dedup.append_deals(sheet, new)


@query("inv_inserted")
def inv_inserted(spark, d):
    """Investment comparables of odd rows put into a sheet of the even ones: inserted, merged or duplicate, and of which row."""
    inv = table(spark, d, INV)
    return dedup.insert_investments(inv.where("row_no % 2 = 0"), inv.where("row_no % 2 = 1"))


@query("insert_counts")
def insert_counts(spark, d):
    return reports.action_counts(QUERIES["insert_actions"](spark, d))


QUERIES |= {
    "p4_found": timestamps.p4_found,
    "p5_found": impute.p5_found,
    "p5_imputed": impute.p5_imputed,
    "p7_found": areas.p7_found,
    "p7_floor_areas": areas.p7_floor_areas,
}
