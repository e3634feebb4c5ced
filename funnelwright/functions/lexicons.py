"""Fixed word lists of the text checks and of finding themes, stated plainly."""

# English phrase groups.
PHRASES = {
    "openers": [
        "here's the thing", "here's what", "here's this", "here's that", "here's why", "the uncomfortable truth is", "it turns out", "let me be clear", "the truth is",
        "i'll say it again", "i'm going to be honest", "can we talk about", "here's the problem though",
    ],
    "crutches": ["full stop", "period.", "let that sink in", "this matters because", "make no mistake", "here's why that matters"],
    "jargon": [
        "navigate", "unpack", "lean into", "landscape", "game-changer", "double down", "deep dive", "take a step back", "moving forward", "circle back", "on the same page",
    ],
    "adverbs": [
        "really", "just", "literally", "genuinely", "honestly", "simply", "actually", "deeply", "truly", "fundamentally", "inherently", "inevitably", "interestingly", "importantly", "crucially",
    ],
    "filler": ["at its core", "in today's", "it's worth noting", "at the end of the day", "when it comes to", "in a world where", "the reality is", "in order to"],
    "vague": ["the reasons are structural", "the implications are significant", "this is the deepest problem", "the stakes are high", "the consequences are real"],
    "meta": ["hint:", "plot twist:", "spoiler:", "you already know this, but", "but that's another post", "dressed up as", "let me walk you through", "in this section, we'll", "as we'll see", "i want to explore", "is a feature, not a bug", "the rest of this essay"],
    "performative": ["creeps in", "i promise"],
    "telling": ["this is genuinely hard", "this is what leadership actually looks like", "actually looks like", "actually matters"],
    "inflation": ["is a testament", "pivotal role", "crucial role", "setting the stage for", "key turning point", "evolving landscape", "focal point", "indelible mark", "deeply rooted"],
    "promotion": ["boasts a", "vibrant", "profound", "showcasing", "exemplifies", "commitment to", "natural beauty", "nestled", "in the heart of", "groundbreaking", "renowned", "breathtaking", "must-visit", "stunning"],
    "attribution": ["industry reports", "observers have cited", "experts argue", "some critics argue", "several sources", "several publications"],
    "chat": ["i hope this helps", "of course!", "certainly!", "you're absolutely right!", "would you like", "let me know", "here is a"],
    "signposts": ["let's dive in", "let's explore", "let's break this down", "here's what you need to know", "now let's look at", "without further ado"],
}

# Chinese phrase groups.
PHRASES_ZH = {
    "openers": ["值得注意的是", "需要指出的是", "众所周知", "不难发现", "由此可见", "与此同时", "除此之外", "在此基础上", "总的来说", "综上所述", "总而言之", "归根结底", "放眼未来", "展望未来"],
    "inflation": ["标志着", "彰显了", "体现了", "具有重要意义", "指明了方向"],
    "jargon": ["赋能", "抓手", "闭环", "对齐", "打法", "心智", "链路", "颗粒度", "组合拳", "护城河", "价值点", "卡位", "破圈", "沉淀", "反哺", "强心智", "做深做透", "底层逻辑", "顶层设计"],
    "endings": ["未来可期", "前景广阔", "潜力巨大", "大有可为", "持续发力", "再创佳绩", "迈向新高度", "共创美好未来"],
    "chat": ["希望以上内容对您有所帮助", "如有任何疑问随时联系", "这是一个非常好的问题", "您说得很对", "很高兴为您解答", "以下是为您整理的"],
    "connectives": ["首先", "其次", "再者", "最后"],
    "filler": ["在目前这个阶段", "进行了一次深入的分析"],
    "vague": ["大量", "众多", "显著", "有效", "相关数据显示", "业内普遍认为", "有研究表明", "据了解", "一定程度上"],
}

# Theme keywords of findings, first match wins.
THEMES = {
    "Funnel": ["funnel", "conversion", "drop-off", "dropout", "drop off", "checkout", "cart"],
    "Segment": ["segment", "cohort", "group", "mobile", "desktop", "ios", "android", "plan", "tier"],
    "Trend": ["trend", "growth", "decline", "mom", "wow", "yoy", "month-over-month", "week-over-week", "year-over-year", "increasing", "decreasing"],
    "Anomaly": ["anomaly", "spike", "dip", "unusual", "outlier", "unexpected", "sudden"],
    "Engagement": ["retention", "churn", "engagement", "active", "session", "dau", "wau", "mau", "stickiness"],
}

# Dimension words counted across findings.
DIMENSION_WORDS = ["mobile", "desktop", "ios", "android", "new user", "returning", "enterprise", "smb", "free", "paid", "web", "app"]
