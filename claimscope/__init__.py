"""claimscope: news-article and link-post analysis as Spark DataFrame plans."""
