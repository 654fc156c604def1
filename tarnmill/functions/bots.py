"""Known crawlers by user agent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (substring of the lower-cased user agent, name, category); the first that is contained wins.
SIGNATURES = (
    ("googlebot-image", "Googlebot-Image", "search_media"),
    ("googlebot-video", "Googlebot-Video", "search_media"),
    ("googlebot-news", "Googlebot-News", "search_media"),
    ("storebot-google", "StoreBot-Google", "search_engine"),
    ("google-inspectiontool", "Google-InspectionTool", "search_engine"),
    ("googleother", "GoogleOther", "search_engine"),
    ("google-extended", "Google-Extended", "ai_training"),
    ("googlebot", "Googlebot", "search_engine"),
    ("bingbot", "Bingbot", "search_engine"),
    ("gptbot", "GPTBot", "ai_training"),
    ("oai-searchbot", "OAI-SearchBot", "ai_search"),
    ("chatgpt-user", "ChatGPT-User", "ai_search"),
    ("claudebot", "ClaudeBot", "ai_training"),
    ("claude-searchbot", "Claude-SearchBot", "ai_search"),
    ("claude-user", "Claude-User", "ai_search"),
    ("perplexitybot", "PerplexityBot", "ai_search"),
    ("bytespider", "Bytespider", "ai_training"),
    ("ccbot", "CCBot", "ai_training"),
    ("meta-externalagent", "Meta-ExternalAgent", "ai_training"),
    ("amazonbot", "Amazonbot", "ai_training"),
    ("applebot-extended", "Applebot-Extended", "ai_training"),
    ("duckassistbot", "DuckAssistBot", "ai_search"),
    ("gemini-deep-research", "Gemini-Deep-Research", "ai_search"),
    ("diffbot", "Diffbot", "ai_training"),
    ("mistralai-user", "MistralAI-User", "ai_search"),
    ("cohere-ai", "Cohere-AI", "ai_training"),
    ("yandexbot", "YandexBot", "search_engine"),
    ("baiduspider", "Baiduspider", "search_engine"),
    ("duckduckbot", "DuckDuckBot", "search_engine"),
    ("applebot", "Applebot", "search_engine"),
    ("sogou", "Sogou", "search_engine"),
    ("seznambot", "SeznamBot", "search_engine"),
    ("naverbot", "NaverBot", "search_engine"),
    ("yeti/", "Yeti", "search_engine"),
    ("ahrefs", "AhrefsBot", "seo_tool"),
    ("semrushbot", "SemrushBot", "seo_tool"),
    ("mj12bot", "MJ12Bot", "seo_tool"),
    ("dotbot", "DotBot", "seo_tool"),
    ("screaming frog", "Screaming Frog", "seo_tool"),
    ("facebookexternalhit", "Facebook", "social_media"),
    ("twitterbot", "TwitterBot", "social_media"),
    ("linkedinbot", "LinkedInBot", "social_media"),
    ("pinterestbot", "PinterestBot", "social_media"),
    ("slackbot", "SlackBot", "social_media"),
    ("telegrambot", "TelegramBot", "social_media"),
    ("discordbot", "DiscordBot", "social_media"),
    ("whatsapp", "WhatsApp", "social_media"),
    ("feedfetcher", "FeedFetcher", "feed_crawler"),
    ("feedly", "Feedly", "feed_crawler"),
    ("uptimerobot", "UptimeRobot", "monitoring"),
    ("pingdom", "Pingdom", "monitoring"),
    ("statuscake", "StatusCake", "monitoring"),
)


#: What marks a crawler that no signature names.
GENERIC = ("bot/", "spider", "crawler", "scraper")
OTHER = ("", "Other Bot", "other_bot")


def signature(lowered: Column) -> Column:
    """Place of the first signature that a lower-cased user agent contains, len(SIGNATURES) for other crawlers, else null.
    One chain, evaluated once a row: name and category are looked up by place."""
    generic = F.lit(False)
    for word in GENERIC:
        generic = generic | F.contains(lowered, F.lit(word))
    out = None
    for i, s in enumerate(SIGNATURES):
        hit = F.contains(lowered, F.lit(s[0]))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.when(generic, len(SIGNATURES))


def _at(place: Column, what: int) -> Column:
    return F.get(F.array(*[F.lit(s[what]) for s in (*SIGNATURES, OTHER)]), place)


def name_at(place: Column) -> Column:
    return _at(place, 1)


def category_at(place: Column) -> Column:
    return _at(place, 2)


def bot_name(user_agent: Column) -> Column:
    """Name of the first signature that the user agent contains; null for others."""
    return name_at(signature(F.lower(user_agent)))


def bot_category(user_agent: Column) -> Column:
    return category_at(signature(F.lower(user_agent)))


def category_of(name: Column) -> Column:
    """Category of a bot by its name: the same for all its signatures."""
    return F.create_map(*[F.lit(x) for s in (*SIGNATURES, OTHER) for x in (s[1], s[2])])[name]


def is_mobile(user_agent: Column) -> Column:
    ua = F.lower(user_agent)
    return F.contains(ua, F.lit("mobile"))
