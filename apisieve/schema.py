"""Schemas of the canonical tables, as DDL."""

DOC = "struct<type:string,default_value:string,description:string>"
TYPE = "array<struct<kind:string,name:string,values:array<string>,base_type:string,min:double,max:double,min_inclusive:boolean,max_inclusive:boolean,full_match:string>>"

MODULES = "id string, name string, imports array<struct<module:string,alias:string>>, from_imports array<struct<module:string,declaration:string,alias:string>>, classes array<string>, functions array<string>"
CLASSES = (
    "id string, name string, qname string, decorators array<string>, superclasses array<string>, methods array<string>, is_public boolean, reexported_by array<string>, "
    "description string, docstring string, code string, instance_attributes array<struct<id:string,name:string,types:array<string>>>"
)
FUNCTIONS = "id string, name string, qname string, decorators array<string>, is_public boolean, reexported_by array<string>, description string, docstring string, code string, parent_id string, parent_kind string"
PARAMETERS = f"id string, name string, qname string, function_id string, ordinal int, default_value string, assigned_by string, is_public boolean, docstring {DOC}"
COUNTS = "kind string, id string, value string, n long, first_seen long"
ANNOTATIONS = (
    "kind string, target string, authors array<string>, reviewers array<string>, comment string, reviewResult string, variant string, default_value_type string, default_value string, "
    "enum_name string, pairs array<struct<stringValue:string,instanceName:string>>, interval struct<isDiscrete:boolean,lowerIntervalLimit:double,lowerLimitType:int,upperIntervalLimit:double,upperLimitType:int>, "
    "calledAfterName string, newDescription string, groupName string, parameters array<string>, destination string, newName string, newTodo string, "
    "is_depending_on array<string>, has_dependent_parameter array<string>, condition string, action string"
)
#: The kinds of parameter assignment.
ASSIGNED_BY = ("IMPLICIT", "POSITION_ONLY", "POSITION_OR_NAME", "POSITIONAL_VARARG", "NAME_ONLY", "NAMED_VARARG")
#: Review results, by the order that duplicates are kept in.
REVIEW_ORDER = ("correct", "", "unsure", "wrong")
AUTOGEN, MIGRATION = "$autogen$", "migration"
KINDS = ("class", "attribute", "function", "parameter", "result")
