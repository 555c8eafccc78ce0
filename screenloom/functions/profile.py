"""Fields of a profile, made regular. What can't be is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, composed_names, fold_space, let, match_form

MIN_PHONE_DIGITS, MAX_STATED_YEARS = 7, 80


def email(c: Column) -> Column:
    """One @ with something before it and, after it, two names or more with a dot between each."""
    t = F.lower(blank_to_null(c))
    sides = F.split(t, "@")
    names = F.split(F.get(sides, F.lit(1)), r"\.")
    good = (F.size(sides) == 2) & (F.get(sides, F.lit(0)) != "") & (F.size(names) > 1) & F.forall(names, lambda n: n != "") & ~F.contains(t, F.lit(" "))
    return F.when(good, t)


def phone(c: Column) -> Column:
    """As written, if it has enough digits to be dialled."""
    t = blank_to_null(c)
    return F.when(F.length(F.regexp_replace(t, r"\D", "")) >= MIN_PHONE_DIGITS, t)


def linkedin(c: Column) -> Column:
    """A link whose host is linkedin.com or one under it; the scheme may be missing."""
    t = blank_to_null(c)
    host = F.lower(F.substring_index(F.element_at(F.split(t, "//", 2), -1), "/", 1))
    pathed = F.contains(F.element_at(F.split(t, "//", 2), -1), F.lit("/"))
    return F.when(pathed & ((host == "linkedin.com") | host.endswith(".linkedin.com")), t)


def country(c: Column) -> Column:
    t = F.upper(blank_to_null(c))
    return F.when(t.rlike("^[A-Z]{2}$"), t)


def location(city: Column, region: Column, code: Column) -> Column:
    """The three as a struct; null if none of them is given. What is given and can't be read is null in it."""
    parts = {"city": blank_to_null(city), "region": blank_to_null(region), "countryCode": country(code)}
    return F.when(F.coalesce(city, region, code).isNotNull(), F.struct(*(v.alias(k) for k, v in parts.items())))


def stated_years(c: Column) -> Column:
    ok = ~F.isnan(c) & c.between(0, MAX_STATED_YEARS)
    return F.when(ok, F.floor(c * 10 + 0.5) / 10)


#: The fields of a profile as it comes in, flat but for its four lists. The walk of normalised()
#: and the paths in its log follow from these alone.
WIRE = {
    "email": "string", "phone": "string", "linkedinUrl": "string", "fullName": "string",
    "locationCity": "string", "locationRegion": "string", "locationCountryCode": "string", "statedYearsExperience": "double",
    "workHistory": ("employer", "title", "startDate", "endDate", "summary"),
    "education": ("institution", "degree", "field", "level", "endDate"),
    "certifications": ("name", "issuer", "issuedDate", "expiryDate"),
    "skills": ("name", "evidenceType", "evidenceQuote"),
}
#: Fields that are words of a closed list and stay as they are.
CLOSED = ("level", "evidenceType")
#: What a scalar that can't be read as its kind says for a reason.
SCALARS = {"email": (email, "not_an_address"), "phone": (phone, "too_few_digits"), "linkedinUrl": (linkedin, "not_a_linkedin_url")}
EMPTIED, INVALID, DROPPED, MERGED = "nulled_empty", "nulled_invalid", "dropped_entry", "deduplicated"


def wire_schema() -> str:
    entry = lambda fields: "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return "struct<" + ",".join(f"{k}:{v if isinstance(v, str) else entry(v)}" for k, v in WIRE.items()) + ">"


def change(condition: Column, field: Column | str, action: str, reason: str | None = None) -> Column:
    """An entry of the log where the condition holds, else null."""
    path = F.lit(field) if isinstance(field, str) else field
    return F.when(condition, F.struct(path.alias("field"), F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason")))


def scalar(c: Column, name: str) -> tuple[Column, list[Column]]:
    """A scalar of the profile as it should be, and what was done to it."""
    tidy = blank_to_null(c)
    log = [change(c.isNotNull() & tidy.isNull(), name, EMPTIED)]
    if name not in SCALARS:
        return tidy, log
    read, reason = SCALARS[name]
    return read(c), [*log, change(tidy.isNotNull() & read(c).isNull(), name, INVALID, reason)]


def entries_of(c: Column, name: str) -> Column:
    """A list of the profile: its entries as they should be, and the log, as structs of entry and log. An
    entry without the name it needs is null."""
    fields = WIRE[name]
    named = fields[0] == "name"

    def one(e: Column, i: Column) -> Column:
        # each text is folded once, and all that is said of it reads that
        return let(F.struct(*(blank_to_null(e[f]).alias(f) for f in fields if f not in CLOSED)), lambda t: told(e, i, t))

    def told(e: Column, i: Column, folded: Column) -> Column:
        at = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
        blank = folded["name"].isNull() if named else F.lit(False)
        values, log = [], [change(blank, at, DROPPED, "blank_name")]
        for f in fields:
            tidy = e[f] if f in CLOSED else folded[f]
            path = F.concat(at, F.lit(f".{f}"))
            if f == "evidenceQuote":
                shown = F.coalesce(e["evidenceType"] == "demonstrated", F.lit(False))
                tidy = F.when(shown, tidy)
                log.append(change(~blank & ~shown & e[f].isNotNull(), path, INVALID, "quote_without_demonstration"))
            elif f not in (*CLOSED, "name"):
                log.append(change(~blank & e[f].isNotNull() & tidy.isNull(), path, EMPTIED))
            values.append(tidy.alias(f))
        return F.struct(F.when(~blank, F.struct(*values)).alias("entry"), F.array_compact(F.array(*log)).alias("log"))

    return F.transform(c, one)


def merged_skills(done: Column, keys: Column) -> Column:
    """What entries_of() gives of skills, with later mentions of a skill (of the same key) merged into the
    first: they are null, the log says so, and the first one that shows the skill in use gives the evidence."""

    def one(x: Column, i: Column) -> Column:
        key = F.get(keys, i)
        first = F.array_position(keys, key) - 1
        own = F.filter(done, lambda y, k: (F.get(keys, k) == key) & (y["entry"]["evidenceType"] == "demonstrated"))
        best = F.coalesce(F.get(own, F.lit(0))["entry"], x["entry"])
        again = x["entry"].isNotNull() & (first < i)
        at = F.concat(F.lit("skills["), i.cast("string"), F.lit("]"))
        entry = F.when(~again, F.when(x["entry"].isNotNull(), best.withField("name", x["entry"]["name"])))
        return F.struct(entry.alias("entry"), F.concat(x["log"], F.array_compact(F.array(change(again, at, MERGED)))).alias("log"))

    return F.transform(done, one)


def normalised(wire: Column) -> Column:
    """struct<profile, changes> of a profile of wire_schema(): absent fields null, the location nested, every
    text tidied, what can't be read null, entries without a name gone, skills merged; and the log of what
    was taken away: field (such as workHistory[2].title), action and reason, in the order of WIRE.

    A list that is absent stays null, and one that is empty stays empty. Blank parts of a location are not logged.
    The profile is put together once, and not where each of its fields is read."""
    keys = F.transform(composed_names(wire["skills"]), lambda e: match_form(e["name"], compose=False))
    return let(F.struct(wire.alias("wire"), keys.alias("keys")), lambda x: walked(x["wire"], x["keys"]))


def walked(wire: Column, keys: Column) -> Column:
    """As normalised(), with the names of skills in match form as keys."""
    values, log = {}, []
    for name, kind in WIRE.items():
        if kind == "string" and not name.startswith("location"):
            values[name], said = scalar(wire[name], name)
            log.append(F.array_compact(F.array(*said)))
    place = [wire[f"location{part}"] for part in ("City", "Region", "CountryCode")]
    values["location"] = location(*place)
    years = wire["statedYearsExperience"]
    values["statedYearsExperience"] = stated_years(years)
    unread = change(blank_to_null(place[2]).isNotNull() & country(place[2]).isNull(), "location.countryCode", INVALID, "not_iso_alpha_2")
    implausible = change(years.isNotNull() & stated_years(years).isNull(), "statedYearsExperience", INVALID, "implausible")
    log.append(F.array_compact(F.array(unread, implausible)))
    lists = [name for name, kind in WIRE.items() if not isinstance(kind, str)]
    done = F.struct(*(entries_of(wire[name], name).alias(name) for name in lists), keys.alias("keys"))

    def built(done: Column) -> Column:
        skills = merged_skills(done["skills"], done["keys"])

        def whole(skills: Column) -> Column:
            of = {name: done[name] for name in lists} | {"skills": skills}
            kept = {name: F.filter(F.transform(of[name], lambda x: x["entry"]), lambda e: e.isNotNull()) for name in lists}
            logs = [F.coalesce(F.flatten(F.transform(of[name], lambda x: x["log"])), F.array().cast("array<struct<field:string,action:string,reason:string>>")) for name in lists]
            fields = values | kept
            return F.struct(F.struct(*(v.alias(k) for k, v in fields.items())).alias("profile"), F.concat(*log, *logs).alias("changes"))

        return let(skills, whole)

    return let(done, built)


def named_entries(entries: Column) -> Column:
    """Entries with their names folded; those without a name go."""
    return F.filter(F.transform(entries, lambda e: e.withField("name", blank_to_null(e["name"]))), lambda e: e["name"].isNotNull())


def merge_skills(skills: Column) -> Column:
    """One entry for each name in match form, in order of first mention: the first name given, and
    the first evidence that shows the skill in use, if any does, else the first."""
    keyed = F.transform(composed_names(skills), lambda s, i: F.struct(match_form(s["name"], compose=False).alias("k"), i.alias("i"), s.alias("s")))

    def by_name(keyed: Column) -> Column:
        def merged(k: Column) -> Column:
            own = F.filter(keyed, lambda x: x["k"] == k)
            first = F.get(own, F.lit(0))
            best = F.coalesce(F.get(F.filter(own, lambda x: x["s"]["evidenceType"] == "demonstrated"), F.lit(0)), first)["s"]
            return F.struct(fold_space(F.get(skills, first["i"])["name"]).alias("name"), best["evidenceType"].alias("evidenceType"), best["evidenceQuote"].alias("evidenceQuote"))

        return F.transform(F.filter(F.array_distinct(F.transform(keyed, lambda x: x["k"])), lambda k: k != ""), merged)

    return let(keyed, by_name)


def redact(profile: Column, fields: tuple[str, ...] = ("fullName", "email", "phone", "linkedinUrl")) -> Column:
    """The profile with what identifies a person set to null; its shape stays."""
    for f in fields:
        profile = profile.withField(f, F.lit(None).cast("string"))
    return profile
