"""Site rules, read once on the driver and turned into Column expressions by ``hitloom.functions``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from hitloom import defaults


@dataclass(frozen=True)
class BotRule:
    family: str
    pattern: str
    category: str = "Other"


@dataclass(frozen=True)
class UrlRule:
    group: str
    match: str  # exact | prefix | regex | ext
    value: str | tuple[str, ...]


@dataclass(frozen=True)
class SiteRules:
    """Everything that decides how a request is labelled."""

    bots: tuple[BotRule, ...]
    referer_bots: tuple[BotRule, ...]
    locales: tuple[str, ...]
    url_rules: tuple[UrlRule, ...]
    section_map: dict[str, str] = field(default_factory=dict)
    fallback_group: str = defaults.FALLBACK_GROUP
    locale_homepage_group: str = defaults.LOCALE_HOMEPAGE_GROUP
    locale_pattern: str = ""
    site_domain: str = ""

    @classmethod
    def default(cls, site_domain: str = "") -> SiteRules:
        return cls(
            bots=tuple(BotRule(*r) for r in defaults.BOT_RULES),
            referer_bots=tuple(BotRule(*r) for r in defaults.REFERER_BOT_RULES),
            locales=defaults.LOCALES,
            url_rules=tuple(UrlRule(*r) for r in defaults.URL_RULES),
            section_map=dict(defaults.SECTION_MAP),
            locale_pattern=defaults.LOCALE_PATTERN,
            site_domain=site_domain,
        )

    @classmethod
    def from_dict(cls, bots: dict | None = None, urls: dict | None = None, site_domain: str = "") -> SiteRules:
        """Build from the mappings of a bot-rule file and a URL-group file.

        A missing mapping keeps the defaults of that part.
        """
        base = cls.default(site_domain)
        bot_rules, referer_rules = base.bots, base.referer_bots
        if bots is not None:
            bot_rules = _bot_rules(bots.get("rules"))
            referer_rules = _bot_rules(bots.get("referer_rules"))
        if urls is None:
            return cls(bot_rules, referer_rules, base.locales, base.url_rules, base.section_map,
                       locale_pattern=base.locale_pattern, site_domain=site_domain)
        locales = (str(x).strip().lower() for x in urls.get("locales") or ())
        return cls(
            bots=bot_rules,
            referer_bots=referer_rules,
            locales=tuple(x for x in locales if x),
            url_rules=_url_rules(urls.get("rules")),
            section_map={k.lower(): v for k, v in (urls.get("section_map") or {}).items()},
            fallback_group=urls.get("fallback_group") or defaults.FALLBACK_GROUP,
            locale_homepage_group=urls.get("locale_homepage_group") or defaults.LOCALE_HOMEPAGE_GROUP,
            locale_pattern=urls.get("locale_homepage_pattern") or "",
            site_domain=site_domain,
        )

    @classmethod
    def from_profile(cls, row: dict, bots: dict | None = None) -> SiteRules:
        """Build from a stored profile row, whose list and map fields are JSON text."""
        settings = json.loads(row.get("settings") or "{}")
        urls = {
            "locales": json.loads(row["locale_whitelist"]),
            "rules": json.loads(row["url_group_rules"]),
            "section_map": json.loads(row["section_mappings"]),
            **{k: settings.get(k) for k in ("fallback_group", "locale_homepage_group", "locale_homepage_pattern")},
        }
        return cls.from_dict(bots=bots, urls=urls, site_domain=(row.get("domain") or "").strip().lower())

    @classmethod
    def load(cls, bots_path: str | None = None, urls_path: str | None = None, site_domain: str = "") -> SiteRules:
        return cls.from_dict(
            bots=_read_mapping(bots_path) if bots_path else None,
            urls=_read_mapping(urls_path) if urls_path else None,
            site_domain=site_domain,
        )


def _bot_rules(entries) -> tuple[BotRule, ...]:
    return tuple(BotRule(e["family"], e["pattern"], e.get("category") or "Other") for e in entries or ())


def _url_rules(entries) -> tuple[UrlRule, ...]:
    rules = []
    for e in entries or ():
        value = e["value"]
        if e["match"] == "ext":
            value = (value,) if isinstance(value, str) else tuple(str(x) for x in value)
        rules.append(UrlRule(e["group"], e["match"], value if isinstance(value, tuple) else str(value)))
    return tuple(rules)


def _read_mapping(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML rules needs PyYAML; use a .json rule file instead") from e
    return yaml.safe_load(text)
