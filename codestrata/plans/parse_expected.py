"""Rows that the parsers give for their fixture; what isn't named is empty.

Taken from the parsers' own output and then read against the fixture by hand: they guard against changes and are no
second computation.
"""

from __future__ import annotations

COLUMNS = ['alias', 'bases', 'blank_lines', 'calls', 'class_variables', 'code_lines', 'cognitive', 'comment_lines', 'cyclomatic', 'decorators', 'docstring', 'end_line', 'file', 'flags', 'import_type', 'imported_names', 'instance_variables', 'kind', 'line', 'lines_of_code', 'local_definitions', 'metaclass', 'methods', 'module', 'name', 'nested_classes', 'parameters', 'parent_class', 'parse_success', 'reads_globals', 'relative_level', 'return_type', 'signature', 'throws', 'total_lines', 'unique_id', 'visibility', 'writes_globals']

ROWS: list[dict[str, str]] = [
    {'kind': 'function', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:Store.__init__', 'name': '__init__', 'line': '18', 'end_line': '21', 'signature': 'def __init__(path: str, *rest, size = LIMIT, **more)', 'parent_class': 'Store', 'cyclomatic': '1', 'cognitive': '1', 'lines_of_code': '4', 'calls': 'super().__init__,super', 'reads_globals': 'LIMIT', 'local_definitions': 'more,path,rest,self,size', 'parameters': 'path:str,*rest,size:=LIMIT,**more', 'flags': 'method'},
    {'kind': 'function', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:Store.full', 'name': 'full', 'line': '24', 'end_line': '25', 'signature': 'def full() -> bool', 'return_type': 'bool', 'parent_class': 'Store', 'cyclomatic': '2', 'cognitive': '1', 'lines_of_code': '2', 'decorators': 'property', 'calls': 'len,os.path.exists', 'reads_globals': 'LIMIT', 'local_definitions': 'self', 'flags': 'method,property'},
    {'kind': 'function', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:Store.make', 'name': 'make', 'line': '28', 'end_line': '29', 'signature': 'def make(n: int = 3)', 'parent_class': 'Store', 'cyclomatic': '3', 'cognitive': '0', 'lines_of_code': '2', 'decorators': 'staticmethod', 'calls': 'Store,str,range', 'local_definitions': 'i,n', 'parameters': 'n:int:=3', 'flags': 'method,static'},
    {'kind': 'function', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:load', 'name': 'load', 'line': '35', 'end_line': '44', 'signature': 'async def load(path)', 'docstring': 'Read all rows.', 'cyclomatic': '3', 'cognitive': '5', 'lines_of_code': '10', 'calls': 'read,tick,Store', 'writes_globals': 'count', 'local_definitions': 'path,row', 'parameters': 'path', 'flags': 'async,generator,await'},
    {'kind': 'function', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:walk', 'name': 'walk', 'line': '47', 'end_line': '54', 'signature': 'def walk(n)', 'cyclomatic': '7', 'cognitive': '10', 'lines_of_code': '8', 'calls': 'open,walk', 'local_definitions': 'f,n', 'parameters': 'n'},
    {'kind': 'class', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:Store', 'name': 'Store', 'line': '13', 'end_line': '32', 'docstring': 'A store.', 'metaclass': 'ABCMeta', 'bases': 'Base', 'methods': '__init__,full,make', 'class_variables': 'kind', 'instance_variables': 'path,rows', 'nested_classes': 'Inner', 'flags': 'abstract'},
    {'kind': 'class', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:Inner', 'name': 'Inner', 'line': '31', 'end_line': '32'},
    {'kind': 'variable', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:__all__', 'name': '__all__', 'line': '7'},
    {'kind': 'variable', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:LIMIT', 'name': 'LIMIT', 'line': '8', 'flags': 'constant'},
    {'kind': 'variable', 'file': 'pkg/store.py', 'unique_id': 'pkg/store.py:count', 'name': 'count', 'line': '9', 'return_type': 'int'},
    {'kind': 'import', 'file': 'pkg/store.py', 'line': '2', 'module': 'os', 'relative_level': '0'},
    {'kind': 'import', 'file': 'pkg/store.py', 'line': '3', 'module': 'numpy', 'alias': 'np', 'relative_level': '0'},
    {'kind': 'import', 'file': 'pkg/store.py', 'line': '4', 'module': 'base', 'relative_level': '1', 'imported_names': 'Base', 'flags': 'relative'},
    {'kind': 'import', 'file': 'pkg/store.py', 'line': '5', 'module': 'util', 'relative_level': '2', 'flags': 'relative,star'},
    {'kind': 'module', 'file': 'pkg/store.py', 'name': 'pkg/store.py', 'docstring': 'Keeps rows.', 'total_lines': '55', 'code_lines': '38', 'comment_lines': '4', 'blank_lines': '13', 'parse_success': 'true', 'imported_names': 'Store,load'},
    {'kind': 'function', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader.read', 'name': 'read', 'line': '12', 'end_line': '16', 'signature': 'public static int read(final String path, int... at) throws IOException, Odd', 'return_type': 'int', 'visibility': 'public', 'parent_class': 'Reader', 'cyclomatic': '5', 'cognitive': '7', 'lines_of_code': '5', 'decorators': 'public,static', 'throws': 'IOException,Odd', 'calls': 'this.none,other.go', 'parameters': 'path:String,*at:int...', 'flags': 'method,static'},
    {'kind': 'function', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader.text', 'name': 'text', 'line': '19', 'end_line': '19', 'signature': 'protected String text()', 'return_type': 'String', 'visibility': 'protected', 'parent_class': 'Reader', 'cyclomatic': '1', 'cognitive': '0', 'lines_of_code': '1', 'decorators': 'Override,protected', 'flags': 'method'},
    {'kind': 'function', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader.later', 'name': 'later', 'line': '17', 'end_line': '17', 'signature': 'abstract void later(int n)', 'return_type': 'void', 'parent_class': 'Reader', 'cyclomatic': '1', 'cognitive': '0', 'lines_of_code': '1', 'decorators': 'abstract', 'parameters': 'n:int', 'flags': 'method'},
    {'kind': 'function', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Closer.close', 'name': 'close', 'line': '23', 'end_line': '23', 'signature': 'void close()', 'return_type': 'void', 'visibility': 'public', 'parent_class': 'Closer', 'cyclomatic': '1', 'cognitive': '0', 'lines_of_code': '1', 'flags': 'method'},
    {'kind': 'class', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader', 'name': 'Reader', 'line': '8', 'end_line': '21', 'visibility': 'public', 'decorators': 'Deprecated', 'bases': 'Base,Closer,Other', 'methods': 'read,text,later', 'class_variables': 'MAX', 'instance_variables': 'name,other', 'nested_classes': 'Kind'},
    {'kind': 'class', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Kind', 'name': 'Kind', 'line': '20', 'end_line': '20', 'flags': 'dataclass'},
    {'kind': 'class', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Closer', 'name': 'Closer', 'line': '23', 'end_line': '23', 'methods': 'close', 'flags': 'abstract,interface'},
    {'kind': 'variable', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader.MAX', 'name': 'MAX', 'line': '9', 'return_type': 'int', 'visibility': 'private', 'parent_class': 'Reader', 'flags': 'static,constant'},
    {'kind': 'variable', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader.name', 'name': 'name', 'line': '10', 'return_type': 'String', 'parent_class': 'Reader'},
    {'kind': 'variable', 'file': 'pkg/Reader.java', 'unique_id': 'pkg/Reader.java:Reader.other', 'name': 'other', 'line': '10', 'return_type': 'String', 'parent_class': 'Reader'},
    {'kind': 'import', 'file': 'pkg/Reader.java', 'line': '2', 'module': 'java.util', 'relative_level': '0', 'import_type': 'import', 'imported_names': 'List'},
    {'kind': 'import', 'file': 'pkg/Reader.java', 'line': '3', 'module': 'java.lang.Math', 'relative_level': '0', 'import_type': 'static', 'flags': 'star'},
    {'kind': 'module', 'file': 'pkg/Reader.java', 'name': 'pkg/Reader.java', 'docstring': 'pkg', 'total_lines': '24', 'code_lines': '18', 'comment_lines': '3', 'blank_lines': '3', 'parse_success': 'true'},
    {'kind': 'function', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Walk.step', 'name': 'step', 'line': '5', 'end_line': '5', 'signature': 'int step(int n) const', 'return_type': 'int', 'visibility': 'public', 'parent_class': 'Walk', 'cyclomatic': '2', 'cognitive': '1', 'lines_of_code': '1', 'calls': 'next', 'parameters': 'n:int', 'flags': 'method'},
    {'kind': 'function', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Path.count', 'name': 'count', 'line': '13', 'end_line': '13', 'signature': 'int Path::count()', 'return_type': 'int', 'parent_class': 'Path', 'cyclomatic': '3', 'cognitive': '1', 'lines_of_code': '1', 'calls': 'a.b,c->d', 'flags': 'method'},
    {'kind': 'function', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Path.count', 'name': 'count', 'line': '11', 'end_line': '11', 'signature': 'static int count()', 'return_type': 'int', 'visibility': 'public', 'parent_class': 'Path', 'cyclomatic': '1', 'cognitive': '0', 'lines_of_code': '1', 'decorators': 'static', 'flags': 'method,static'},
    {'kind': 'class', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Walk', 'name': 'Walk', 'line': '4', 'end_line': '7', 'bases': 'Base', 'methods': 'step', 'instance_variables': 'size', 'flags': 'dataclass'},
    {'kind': 'class', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Path', 'name': 'Path', 'line': '8', 'end_line': '12', 'methods': 'count,count', 'instance_variables': 'hidden'},
    {'kind': 'variable', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Walk.size', 'name': 'size', 'line': '6', 'return_type': 'double', 'visibility': 'public', 'parent_class': 'Walk'},
    {'kind': 'variable', 'file': 'pkg/walk.cpp', 'unique_id': 'pkg/walk.cpp:geo::Path.hidden', 'name': 'hidden', 'line': '9', 'return_type': 'int', 'visibility': 'private', 'parent_class': 'Path'},
    {'kind': 'import', 'file': 'pkg/walk.cpp', 'line': '1', 'module': 'walk.h', 'relative_level': '0', 'import_type': 'include', 'flags': 'relative'},
    {'kind': 'import', 'file': 'pkg/walk.cpp', 'line': '2', 'module': 'vector', 'relative_level': '0', 'import_type': 'include'},
    {'kind': 'module', 'file': 'pkg/walk.cpp', 'name': 'pkg/walk.cpp', 'total_lines': '15', 'code_lines': '14', 'comment_lines': '0', 'blank_lines': '1', 'parse_success': 'true'},
    {'kind': 'module', 'file': 'pkg/broken.py', 'name': 'pkg/broken.py', 'total_lines': '2', 'code_lines': '1', 'comment_lines': '0', 'blank_lines': '1', 'parse_success': 'false'},
]
