"""Fixed values of the analysis: site rules, boilerplate lines, stop words, thresholds, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Paragraphs that are never part of an article.
BAN_LINES = (
    "© 2022 BBC. BBC對外部網站內容不負責任。 閱讀了解我們對待外部鏈接的做法。",
    "圖像來源，Reuters",
    "中時新聞網對留言系統使用者發布的文字、圖片或檔案保有片面修改或移除的權利。當使用者使用本網站留言服務時，表示已詳細閱讀並完全了解，且同意配合下述規定：",
    "違反上述規定者，中時新聞網有權刪除留言，或者直接封鎖帳號！請使用者在發言前，務必先閱讀留言板規則，謝謝配合。",
    "本網站之文字",
    "本網站之文字、圖片及影音，非經授權，不得轉載、公開播送或公開傳輸及利用。",
    "省錢大作戰！超夯優惠等你GO",
    "請繼續往下閱讀...",
    "不用抽 不用搶 現在用APP看新聞 保證天天中獎",
    "Photo Credit:",
    "每月一杯咖啡的金額，支持優質觀點的誕生，享有更好的閱讀體驗。",
    "本文經《BBC News 中文》授權轉載，原文發表於此",
    "更多 TVBS 報導",
    "更多相關新聞,'相關新聞影音",
    "圖／TVBS",
    "圖像來源，NCA",
    "原始連結",
    "點我看更多華視新聞＞＞＞",
    "圖像來源，Getty Images",
    "相關新聞影音",
    "[啟動LINE推播] 每日重大新聞通知",
    "下載法廣應用程序跟蹤國際時事",
)
# The fourteenth line above joins two lines; both parts stand alone too.
BAN_PARTS = ("更多相關新聞", "相關新聞影音")
# Lines after which an article has ended, where a site's rule says so.
BREAK_LINES = ("點我看更多華視新聞＞＞＞", "更多風傳媒報導", "更多 TVBS 報導")

# Stop words of keyword extraction.
STOP_WORDS = (
    ",", "，", ".", "。", "?", "？", "!", "！", "#", "＃", "/", "／", ":", "：", "(", "（", ")", "）", "『", "「", "【", "〖", "［",
    "』", "」", "】", "〗", "］", "[", "]", "-", "_", "＿", "——", "－", "-", "−", "我", "你", "妳", "他", "她", "它", "祂", "是", "的",
    "了", "呢", "嗎", "問", "問題", "問卷", "什麼", "新聞", "分享", "討論", "這個", "那個", "哪個", "最", "爆", "傳", "驚魂", "這項", "曝",
    "這招", "那招", "什麼", "驚", "推", "podcast", "啊啊",
)
#: Function words of the European test languages, the counterpart of the list above for texts that are not segmented.
LATIN_STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "it", "for", "on", "that", "with", "as", "was", "are", "by", "be", "this", "from", "at", "he", "or", "an",
    "der", "die", "und", "das", "von", "mit", "den", "des", "sich", "ein", "im", "als", "auf", "für", "nicht", "dem",
    "le", "la", "de", "les", "et", "des", "un", "une", "du", "que", "est", "en", "pour", "dans", "qui", "sur", "par", "au", "pas",
    "el", "los", "las", "que", "por", "con", "para", "una", "se", "su", "al", "lo", "no",
)

#: Second-level labels under which country registries register names: with a country code of two letters behind them
#: they are a public suffix. The full list of suffixes is a table of the caller's (``operators.domains``).
SECOND_LEVELS = ("com", "co", "org", "or", "net", "ne", "gov", "go", "gob", "govt", "edu", "ac", "idv", "mil", "nom", "ltd", "plc", "sch", "nhs", "gouv", "asso")

# Per site and priority, the selectors of title and paragraphs and how paragraphs end.
# skip: drop ban lines; break: stop at the first ban line; skip_break: drop ban lines, stop at a break line;
# skip_contains, contains: stop at a paragraph that contains the text.
SITE_RULES = (
    ("chinatimes.com", 1, "h1.article-title", "p", "skip", None),
    ("cna.com.tw", 1, "h1", "p", "skip", None),
    ("ettoday.net", 1, "h1.title", "div.story p", "break", None),
    ("ltn.com.tw", 1, "h1", 'div[class="text boxTitle boxText"] p', "break", None),
    ("pts.org.tw", 1, "h1.article-title", "p", "none", None),
    ("newtalk.tw", 1, "h1.content_title", "div#news_content p", "none", None),
    ("setn.com", 1, "h1.news-title-3", "p", "none", None),
    ("thenewslens.com", 1, "h1.article-title", 'div[class="article-content AdAsia"] p', "skip", None),
    ("udn.com", 1, "h1.article-content__title", "div.article-content__paragraph p", "none", None),
    ("udn.com", 2, "div.article-layout-wrapper h1", "section.article-body__editor p", "none", None),
    ("yahoo.com", 1, "header.caas-header h1", "div.caas-body p", "skip_break", None),
    ("yahoo.com", 2, "h1[data-test-locator=headline]", "div.caas-body p", "none", None),
    ("yahoo.com", 3, 'h1[class="Fz(24px) Fw(b)"]', 'div[class="Mt(12px) Fz(16px) Lh(1.5) C(#464e56) Whs(pl)"] > *', "none", None),
    ("rfi.fr", 1, "article h1", 'article div[class="t-content__body u-clearfix"] p', "skip", None),
    ("rti.org.tw", 1, "section.news-detail-box h1", "article p", "none", None),
    ("storm.mg", 1, "h1#article_title", "div#CMS_wrapper p", "skip_contains", "更多風傳媒報導"),
    ("bbc.com", 1, 'h1[class="bbc-1tk77pb e1p3vdyi0"]', "p", "skip", None),
    ("bbc.com", 2, 'strong[class="ewk8wmc0 bbc-uky4hn eglt09e1"]', "p", "skip", None),
    ("mirrormedia.mg", 1, "h1.story__title", "p.g-story-paragraph", "contains", "更多內容，歡迎鏡週刊紙本雜誌、鏡週刊數位訂閱、了解內容授權資訊。"),
    ("cw.com.tw", 1, "div.article__head h1", 'div[class="article__content py20"] p', "none", None),
    ("epochtimes.com", 1, "h1.title", "div#artbody p", "none", None),
    ("nytimes.com", 1, "div.article-header h1", "div.article-paragraph", "none", None),
    ("wsj.com", 1, "h1.wsj-article-headline", "div.wsj-snippet-body p", "none", None),
    ("worldjournal.com", 1, "div.wrapper-left section.article-content__wrapper h1.article-content__title", "section.article-content__editor p", "break", None),
)
# Lines that end an article on single sites only.
SITE_BREAKS = (("worldjournal.com", "上一則"), ("worldjournal.com", "下一則"))
# Fixed value: a note that one site's titles carry.
TITLE_NOTE = " 用Podcast訂閱本節目 "

# Labels of mean sentiment, each with its lower bound; the neutral one is exactly one half.
SENTIMENT_LABELS = ("絕對正面", "極度正面", "相對正面", "中立", "相對負面", "極度負面", "絕對負面")
SENTIMENT_LABELS_EN = ("abs positive", "strong positive", "quite positive", "neutrality", "quite negative", "strong negative", "abs negative")
NO_SENTIMENT = "undefined"

# Verdicts in a fact-check title, most specific first, and the one without a hit.
VERDICTS = ("部份錯誤", "錯誤", "事實釐清")
NO_VERDICT = "目前查無資料"
FACT_CHECK_HOST = "tfc-taiwan"

# Headings of the report table, and the icon service.
REPORT_HEADINGS = ("新聞標題", "新聞標題關鍵字", "新聞內文關鍵字", "情感分析", "事實查覈結果")
ICON_URL = "https://www.google.com/s2/favicons?sz=64&domain_url="


def site_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SITE_RULES), "domain string, priority int, title_sel string, body_sel string, stop_mode string, stop_text string")


def ban_lines(spark: SparkSession) -> DataFrame:
    """(domain, text, mode); a null domain holds for all sites."""
    rows = [(None, x, "skip") for x in dict.fromkeys(BAN_LINES + BAN_PARTS)] + [(None, x, "break") for x in BREAK_LINES] + [(d, x, "break") for d, x in SITE_BREAKS]
    return spark.createDataFrame(rows, "domain string, text string, mode string")
