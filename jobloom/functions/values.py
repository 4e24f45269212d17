"""Word lists, lookup tables, patterns and defaults.

Everything here is data that results depend on, so it is stated plainly. Every
operator takes these lists as arguments and only defaults to them.
"""

from __future__ import annotations

# Technology terms looked for in title and description.
TECH_TERMS = [
    "javascript", "python", "java", "golang", "go", "rust", "c++", "c#",
    "react", "vue", "angular", "node.js", "express", "django", "flask",
    "kubernetes", "docker", "aws", "azure", "gcp", "terraform",
    "mongodb", "postgresql", "mysql", "redis", "elasticsearch",
    "microservices", "api", "rest", "graphql", "grpc",
    "machine learning", "ai", "data science", "blockchain",
    "frontend", "backend", "fullstack", "devops", "mobile",
    "ios", "android", "react native", "flutter",
]

# Terms looked for in postings that come from API providers.
PROVIDER_TERMS = [
    "software", "engineer", "developer", "programming", "java", "python",
    "javascript", "react", "node", "aws", "docker", "kubernetes", "api",
    "database", "sql", "nosql", "mongodb", "postgresql", "mysql",
    "frontend", "backend", "fullstack", "devops", "cloud", "agile",
]

# Skills counted in the agent insights.
SKILL_TERMS = [
    "python", "java", "javascript", "react", "node", "angular", "vue",
    "docker", "kubernetes", "aws", "azure", "gcp", "sql", "mongodb",
    "machine learning", "ai", "data science", "devops", "microservices",
]

# Technologies followed over time (label -> words).
TREND_TERMS = {
    "Python": ["python"],
    "JavaScript": ["javascript"],
    "Java": ["java"],
    "React": ["react"],
    "AI/ML": ["ai", "machine learning"],
    "Go": ["golang"],
    "Kubernetes": ["kubernetes"],
}

# Synonyms added to a query term.
SYNONYMS = {
    "software engineer": ["developer", "programmer", "software developer", "software engineer", "swe"],
    "developer": ["engineer", "programmer", "dev", "software developer"],
    "frontend": ["front-end", "front end", "ui developer", "web developer"],
    "backend": ["back-end", "back end", "server-side", "api developer"],
    "fullstack": ["full-stack", "full stack", "full-stack developer"],
    "devops": ["dev ops", "site reliability engineer", "sre", "infrastructure engineer"],
    "mobile": ["ios", "android", "react native", "flutter", "mobile developer"],
    "javascript": ["js", "node.js", "nodejs", "react", "vue", "angular"],
    "python": ["django", "flask", "fastapi", "python developer"],
    "java": ["spring", "spring boot", "kotlin", "java developer"],
    "golang": ["go", "go developer", "golang developer"],
    "rust": ["rust developer", "systems programming"],
    "remote": ["work from home", "telecommute", "distributed", "wfh"],
    "senior": ["sr", "lead", "principal", "staff"],
    "junior": ["jr", "entry level", "associate", "graduate"],
}

# A query term that contains one of these is dropped.
EXCLUSIONS = [
    "internship", "unpaid", "volunteer", "commission only", "mlm", "pyramid",
    "door to door", "cold calling", "insurance sales",
]

# Seniority, role and stack patterns found in a query.
QUERY_PATTERNS = [
    r"(?i)\b(senior|sr|junior|jr|lead|principal|staff|entry.level)\b",
    r"(?i)\b(engineer|developer|programmer|architect|analyst|manager)\b",
    r"(?i)\b(full.stack|frontend|backend|frontend|devops|mobile)\b",
]

# Words that decide the experience level (title and description).
SENIOR_WORDS = ["senior", "sr.", "lead", "principal"]
JUNIOR_WORDS = ["junior", "jr.", "entry", "graduate"]

# Words in a location that mean remote work.
REMOTE_WORDS = ["remote", "anywhere", "work from home"]

# The narrower lists used by the criteria filter.
CRITERIA_REMOTE_WORDS = ["remote", "work from home", "wfh"]
CRITERIA_FORBIDDEN = {
    "junior": ["senior", "lead", "principal"],
    "senior": ["junior", "intern", "entry"],
}

# Salary texts and the (min, max) they stand for, first hit wins.
SALARY_BANDS = [
    (["100k", "100,000"], (100000, 120000)),
    (["80k", "80,000"], (80000, 100000)),
    (["60k", "60,000"], (60000, 80000)),
]

# Age tokens of a search and their number of days.
DATE_POSTED_DAYS = {
    "1d": 1, "today": 1, "3d": 3, "7d": 7, "week": 7, "14d": 14, "30d": 30, "month": 30,
}

# Texts after which a feed item names the company, in priority order.
COMPANY_CUES = ["at ", "@ ", "company:", "employer:", "hiring:"]
UNKNOWN_COMPANY = "Unknown Company"

# Places looked for in a feed item, in priority order.
PLACES = [
    "remote", "anywhere", "worldwide", "global", "san francisco", "new york",
    "london", "berlin", "toronto", "sydney", "tokyo", "mumbai", "bangalore",
    "austin", "seattle", "boston", "chicago", "denver",
]
UNKNOWN_PLACE = "Not Specified"
UNLISTED_LOCATION = "Not specified"

# Regions of the geographic report (region -> words in a location).
REGIONS = {
    "Remote/Global": ["remote", "anywhere", "worldwide", "global", "work from home", "wfh"],
    "India": ["india", "mumbai", "bangalore", "delhi", "hyderabad", "pune", "chennai"],
    "United States": [
        "united states", "usa", "san francisco", "new york", "austin", "seattle",
        "boston", "chicago", "denver",
    ],
    "Europe": ["europe", "london", "berlin"],
}
OTHER_REGION = "Other"

# Sites whose pages need a browser to render.
JS_SOURCE_NAMES = [
    "linkedin", "glassdoor", "indeed", "naukri", "angel", "wellfound", "ycombinator",
    "greenhouse", "lever", "workday", "bamboohr", "smartrecruiters", "jobvite", "icims",
    "bullhorn", "cornerstone",
]
JS_URL_PARTS = ["jobs.", "careers.", "apply.", "workday", "greenhouse", "lever"]

# Recommended keywords by level, then by words of the profile.
LEVEL_KEYWORDS = {
    "junior": ["junior", "entry level", "trainee", "graduate"],
    "senior": ["senior", "lead", "architect", "principal"],
}
OTHER_LEVEL_KEYWORDS = ["developer", "engineer", "specialist"]
PROFILE_KEYWORDS = [
    (["python"], ["python", "django", "flask", "fastapi"]),
    (["javascript", "js"], ["javascript", "react", "node", "vue"]),
    (["java"], ["java", "spring", "maven", "gradle"]),
    (["data"], ["data science", "machine learning", "analytics"]),
    (["devops"], ["devops", "kubernetes", "docker", "aws"]),
]
MAX_RECOMMENDED = 10

# Tips by level.
LEVEL_TIPS = {
    "junior": [
        "Focus on entry-level positions and internships",
        "Highlight relevant projects and coursework",
        "Consider remote opportunities for broader reach",
    ],
    "senior": [
        "Target leadership and senior technical roles",
        "Emphasize team leadership and project management experience",
        "Look for opportunities to mentor junior developers",
    ],
}
OTHER_LEVEL_TIPS = [
    "Focus on roles matching your technical skills",
    "Consider both individual contributor and team lead positions",
    "Expand search to include related technologies",
]

# Advice texts of search results.
ADVICE_BROADEN = "Consider broadening your search keywords for more opportunities"
ADVICE_SENIOR = "Many results show senior roles - consider highlighting transferable skills"
ADVICE_SKILL = ("'", "' appears frequently - consider emphasizing this skill")
STRATEGY_STORED = (
    "Good database coverage found. Consider database-only searches for faster results."
)
STRATEGY_LIVE = (
    "Live scraping provided additional opportunities. "
    "Consider hybrid approach for comprehensive coverage."
)
STRATEGY_LIMITED = "Limited results found. Try broader keywords or different locations."

# Calls allowed per source (per minute, hour and day).
QUOTAS = {
    "usajobs": (10, 500, 5000),
    "reed": (20, 1000, 10000),
    "jsearch": (30, 500, 5000),
}

# Names and texts given to records of single providers.
REED_SOURCE = "Reed"
USAJOBS_SOURCE = "USAJobs"
JSEARCH_SOURCE = "JSearch"
HN_COMPANY = "Various Companies (HN)"
HN_LOCATION = "Remote/Various"
REMOTEOK_LINK = "https://remoteok.io/remote-jobs/"

# Header of the postings CSV, in order.
CSV_HEADER = [
    "ID", "Title", "Company", "Location", "Salary", "Description", "Link", "Source",
    "Keywords", "Experience Level", "Is Remote", "Relevance Score", "Scraped At",
    "Updated At", "Is Active",
]

# Characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
