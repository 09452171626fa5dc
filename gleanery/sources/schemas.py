"""Schemas of landed data. Everything a registry calls a number or date stays text until it is parsed."""

from __future__ import annotations


def _strings(names: str) -> str:
    return ", ".join(f"{n} string" for n in names.split())


PERMITS = _strings("outlet_name taxpayer_name outlet_city taxpayer_city outlet_address taxpayer_address outlet_zip_code taxpayer_zip_code outlet_state taxpayer_state outlet_naics_code license_type full_name business_name")
BROKERS = _strings("license_type status full_name key_name county license_number")
CONTRACTORS = _strings("license_type business_name owner_name business_telephone owner_telephone business_city_state_zip mailing_address_city_state_zip business_address_line1 mailing_address_line1 business_county license_number")
MAP = "elements array<struct<type:string,id:bigint,tags:map<string,string>>>"
PROVIDERS = (
    "results array<struct<number:string,basic:struct<organization_name:string,authorized_official_telephone_number:string>,"
    "other_names:array<struct<organization_name:string,type:string,code:string>>,taxonomies:array<struct<`desc`:string>>,"
    "addresses:array<struct<address_purpose:string,telephone_number:string,city:string,address_1:string,postal_code:string,state:string>>>>"
)
REGISTRY = "sources map<string,struct<kind:string,url:string,params:map<string,string>,parse:array<string>,practice:string,csv_member:string>>"
CANDIDATE = _strings("firm attorney phone address city profile_url candidate_website recipe source_url source naics license osm_id npi") + ", ord bigint"
CONTACT = "name string, title string, email string, phone string, profile_url string, source_pages array<string>, sources array<string>, schema_person boolean, from_attorney_bio boolean, from_careers_privacy boolean, from_linkedin boolean"
JOB = _strings("job_id source title url company company_url location pay_text posted_text date_posted listing_status detail_status description employment_type seniority_level")
RESULT = (
    "source string, schema_version int, slug string, path string, checked_at string, status string, linkedin_company string, company_id string, owner string,"
    "contacts array<struct<name:string,title:string,profile_url:string,photo_url:string,email:string,location:string>>,"
    "hiring struct<status:string,is_hiring:boolean,stop_reason:string,jobs:array<struct<job_id:string,title:string,url:string,company_url:string,description:string>>>, _corrupt string"
)
POSTS = "handle string, posts array<struct<id:string,text:string,created_at:string,favorite_count:bigint,retweet_count:bigint,reply_count:bigint,quote_count:bigint,bookmark_count:bigint,view_count:bigint>>"
HAR = "log struct<entries:array<struct<request:struct<method:string,url:string,headers:array<struct<name:string>>>,response:struct<status:int,content:struct<text:string>>>>>"
