"""Fixed schemas of the corpus tables, as DDL. Nothing is inferred when files are read."""

VARIABLES = "array<struct<key:string,type:string,label:string,value:string>>"
SUBSECTION = "id string, name string, `order` int, tag string, html_id string, html_class string, callout_box boolean, body string"
SECTION = "id string, name string, `order` int, html_id string, html_class string, has_section_page boolean"
DOCUMENTS = (
    "id string, doc_kind string, title string, short_name string, number string, `group` string, opdiv string, agency string, subagency string, "
    "subagency2 string, application_deadline string, tagline string, author string, subject string, keywords string, theme string, cover string, "
    "cover_image string, before_you_begin string, status string, archived date, successor string, from_doc string, parent string, "
    "conditional_questions map<string,boolean>, modifications date, filename string, created timestamp, updated timestamp, updated_by string"
)
SECTIONS = f"{SECTION}, document_id string"
SUBSECTIONS = (
    f"{SUBSECTION}, section_id string, comparison_type string, diff_strings array<string>, edit_mode string, status string, optional boolean, "
    f"hidden boolean, instructions string, variables {VARIABLES}"
)
AUDIT_EVENTS = "id bigint, event_type int, model string, object_id string, object_repr string, object_json_repr string, changed_fields string, user_id string, datetime timestamp"
USERS = "id string, email string, full_name string, `group` string, is_superuser boolean, is_opdiv_admin boolean, is_composer_admin boolean, is_active boolean"
QUESTIONS = "key string, label string, page int, subsections array<string>"
RAW_HTML = "doc_id string, filename string, html string"
CRAWL_RESULTS = "url string, method string, status int, final_url string, error string"

NESTED_DOCUMENT = (
    "id string, archived string, status string, `group` string, title string, short_name string, number string, opdiv string, agency string, subagency string, "
    "tagline string, filename string, sections array<struct<id:string,name:string,`order`:int,html_id:string,html_class:string,has_section_page:boolean,"
    "subsections:array<struct<id:string,name:string,`order`:int,tag:string,html_id:string,html_class:string,callout_box:boolean,body:string>>>>"
)
TOP_FIELDS = ["title", "short_name", "number", "opdiv", "agency", "subagency", "tagline", "filename"]
