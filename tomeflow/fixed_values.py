"""Statuses, labels and word lists that results depend on. Kept as plain text in natural order."""

STATUSES = ["draft", "active", "ready-for-qa", "review", "doge", "published", "paused", "cancelled"]
STATUS_LABELS = {
    "draft": "Draft",
    "active": "Active",
    "ready-for-qa": "Ready for QA",
    "review": "In review",
    "doge": "Dep Sec",
    "published": "Published",
    "paused": "Paused",
    "cancelled": "Cancelled",
}
CLOSED_STATUSES = ["published", "paused", "cancelled"]
LINK_WARNING_STATUSES = ["draft", "active", "ready-for-qa", "paused"]
REIMPORT_BLOCKED_STATUSES = ["published", "review", "doge", "paused"]

STATUS_ACTIONS = {
    "draft": ["find-replace", "compare", "duplicate", "reimport", "export", "delete"],
    "active": ["find-replace", "compare", "duplicate", "reimport", "export"],
    "ready-for-qa": ["find-replace", "compare", "duplicate", "reimport", "export"],
    "review": ["find-replace", "compare", "duplicate", "export"],
    "doge": ["find-replace", "compare", "duplicate", "export"],
    "published": ["export"],
    "paused": ["find-replace", "compare", "duplicate", "export"],
    "cancelled": ["export"],
}

NO_SECTION_PAGE_WORDS = ["appendix", "appendices", "glossary", "endnotes", "references", "modifications"]

BREADCRUMBS = {
    "review the opportunity": "Review",
    "review the funding opportunity": "Review",
    "ready": "Get Ready",
    "write your application": "Write",
    "understand review": "Understand",
    "prepare your application": "Prepare",
    "build your application": "Build",
    "learn about review": "Learn",
    "submit": "Submit",
    "learn what happens": "Award",
    "contacts": "Contacts",
}
BREADCRUMB_DEFAULT = "⚠️ TODO ⚠️"

FLOATING_CALLOUTS = [
    "Key facts",
    "Key Facts",
    "Key dates",
    "Key Dates",
    "Questions?",
    "Have questions?",
    "**Have questions?",
    "**Have** **questions?**",
]

PAGE_BREAK_RULES = [
    ("eligibility", "step 1"),
    ("program description", "step 1"),
    ("application checklist", "step 5"),
]

GROUP_HEADERS = [
    "basic information",
    "funding details",
    "eligibility",
    "program description",
    "data, monitoring, and evaluation",
    "funding policies and limitations",
]

EVENT_NOISE_FIELDS = ["updated", "status", "hidden", "optional", "conditional_questions", "filename"]
CUSTOM_ACTIONS = ["import", "print", "reimport"]

EDIT_MODES = ["full", "variables", "locked"]
EDIT_MODE_LABELS = {"variables": "Certain text", "locked": "Locked"}
SUBSECTION_STATUS_LABELS = {"default": "Not started", "done": "Done"}

GROUP_LABELS = {
    "acf": "ACF: Administration for Children and Families",
    "acl": "ACL: Administration for Community Living",
    "aspr": "ASPR: Administration for Strategic Preparedness and Response",
    "cdc": "CDC: Centers for Disease Control and Prevention",
    "cms": "CMS: Centers for Medicare & Medicaid Services",
    "hrsa": "HRSA: Health Resources and Services Administration",
    "ihs": "IHS: Indian Health Service",
    "nih": "NIH: National Institutes of Health",
    "staging": "Staging environment",
}

DEAD_LINKS = {
    "www.grants.gov/web/grants/search-grants.html": "grants.gov/search-grants",
    "www.grants.gov/web/grants/forms/sf-424-family.html": "grants.gov/forms/forms-repository/sf-424-family",
    "www.cdc.gov/grants/dictionary/index.html": "www.cdc.gov/grants/dictionary-of-terms/",
}

STEP_3_NAMES = ["step 3: prepare your application", "step 3: write your application"]
STEP_3_ANCHORS = ["other required forms", "standard forms", "application components"]

# Text that opens a metadata line, lower-cased, by field.
METADATA_TEXTS = {
    "number": "opportunity number:", "title": "opportunity name:", "opdiv": "opdiv:", "agency": "agency:", "subagency": "subagency:",
    "subagency2": "subagency2:", "application_deadline": "application deadline:", "tagline": "tagline:", "author": "metadata author:",
    "subject": "metadata subject:", "keywords": "metadata keywords:",
}
COMPARED_FIELDS = [
    "title", "number", "opdiv", "agency", "subagency", "subagency2", "application_deadline", "tagline",
]

# Named character references of HTML that are replaced in text; &amp; comes after all others.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "trade": "™", "sect": "§", "para": "¶", "deg": "°",
    "times": "×", "divide": "÷", "plusmn": "±", "frac12": "½", "frac14": "¼", "frac34": "¾", "cent": "¢", "pound": "£", "euro": "€", "eacute": "é",
    "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß",
}

# Where cover images are kept, and covers chosen by a word of the title.
COVER_FOLDER = "img/cover-img/"
COVER_BY_TITLE = {"pepfar": "cdc-pepfar.jpg"}

# Display labels of the fields a writer fills in; the last one that occurs in a variable's label wins.
INSTANCE_LABELS = {
    "opdiv": "Operating Division",
    "agency": "Agency",
    "title": "NOFO title",
    "short_name": "Short name",
    "number": "NOFO number",
    "activity_code": "Activity Code",
    "federal_assistance_listing": "Federal Assistance Listing",
    "tagline": "Tagline",
    "author": "Metadata Author",
    "subject": "Metadata Subject",
    "keywords": "Metadata Keywords",
}

# Theme by owner or document number (lower-cased), first match wins.
THEME_RULES = [
    ("owner", r"national institutes of health|\bnih\b", "portrait-nih-white"),
    ("owner", r"health resources and services administration|\bhrsa\b", "portrait-hrsa-white"),
    ("number", "cdc-", "portrait-cdc-blue"),
    ("number", "acf-", "portrait-acf-white"),
    ("number", "acl-", "portrait-acl-white"),
    ("number", "cms-", "portrait-cms-white"),
    ("number", "ihs-", "portrait-ihs-white"),
    ("number", "(?:^|-)hrsa-", "portrait-hrsa-white"),
    ("number", "rfa-", "portrait-cdc-blue"),
]
THEME_ELSE = "portrait-nih-white"
