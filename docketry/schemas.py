"""Declared shapes of nested inputs."""

POINT = "struct<x:double,y:double>"
BOX = f"struct<vertices:array<{POINT}>,normalizedVertices:array<{POINT}>>"
SYMBOL = "struct<text:string,confidence:double>"
WORD = f"struct<text:string,description:string,confidence:double,boundingBox:{BOX},bounding_box:{BOX},symbols:array<{SYMBOL}>>"
PARAGRAPH = (
    f"struct<text:string,description:string,confidence:double,boundingBox:{BOX},bounding_box:{BOX},words:array<{WORD}>>"
)
# a block's direct words have the same shape as lines whose own word list is empty
BLOCK = (
    f"struct<text:string,description:string,boundingBox:{BOX},bounding_box:{BOX},"
    f"paragraphs:array<{PARAGRAPH}>,lines:array<{PARAGRAPH}>,words:array<{PARAGRAPH}>>"
)
ANNOTATION = f"struct<text:string,pages:array<struct<blocks:array<{BLOCK}>>>,paragraphs:array<{PARAGRAPH}>>"

# the texts alone
_OWN = "text:string,description:string"
_TEXT_PARAGRAPH = f"struct<{_OWN},words:array<struct<{_OWN},symbols:array<struct<text:string>>>>>"
ANNOTATION_TEXTS = (
    f"struct<text:string,pages:array<struct<blocks:array<struct<paragraphs:array<{_TEXT_PARAGRAPH}>>>>>,"
    f"paragraphs:array<{_TEXT_PARAGRAPH}>>"
)

# one parse of a response reaches every usual place; the annotation itself stays JSON text
WRAPPERS = (
    "struct<results:array<struct<fullTextAnnotation:string,"
    "Data:struct<responses:array<struct<fullTextAnnotation:string>>>>>,"
    "fullTextAnnotation:string,data:struct<fullTextAnnotation:string>,"
    "response:struct<fullTextAnnotation:string>,result:struct<fullTextAnnotation:string>,"
    "payload:struct<fullTextAnnotation:string>,pages:string,text:string>"
)

PIXEL = "struct<x:int,y:int>"
LABEL_ROW = "image STRING, x0 INT, y0 INT, x1 INT, y1 INT, width INT, height INT"
