"""Relational schemas, as DDL strings, of reports, contributions, ratings, keywords, bugs and crawl results."""


REPORTED_LINKS = (
    "Reported_ID int not null, Reported_URL string, Domain string, FakeReport short, BiasedReport short, OutdatedReport short, "
    "OverallScore short, Rated_Pinned short, FirstReportDate date"
)
CONTRIBUTED_LINKS = ("Contribution_ID int not null, Contribution_URL string, Pinned byte, ContributedDate date")
RATING = (
    "Rating_ID int not null, Reported_ID int not null, Page_Reli short, Cf_Poss short, Phi_Poss short, Outdated short, Domain_Reli short, RatedDate date"
)
KEYWORDS = ("Keyword_ID int not null, Title string, Keyword1 string, Keyword2 string, Keyword3 string")
BUG_REPORT = ("Bug_ID int not null, Bug_DATE timestamp, COMMENT string, Bug_IMAGE binary")
NEWS_TITLES_CONTENTS = (
    "ID int not null, news_title string not null, news_content string not null, news_link string not null, news_title_kw string, news_content_kw string, "
    "sentiment_analysis string, createdDate timestamp not null, post_title string, post_kw string, fcc_result string"
)
POSTS_EXTENDED = (
    "post_id string, post_text string, inline_links array<struct<text:string,href:string>>, preview struct<url:string,title:string,description:string,source:string>"
)
TITLES_CSV = ("source string, title string, keyword1 string, keyword2 string, keyword3 string")
TRAIN_CSV = ("title string, label1 string, label2 string, label3 string")
