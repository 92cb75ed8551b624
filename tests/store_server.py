"""A small object store in memory that speaks enough of S3 for Arrow: buckets, objects by
ranges, uploads in parts, copies, deletions and lists."""

import hashlib
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class Store(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def answer(self, code, body=b"", **headers):
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", headers.pop("length", str(len(body))))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def asked(self):
        url = urllib.parse.urlsplit(self.path)
        return urllib.parse.unquote(url.path).lstrip("/"), dict(urllib.parse.parse_qsl(url.query, keep_blank_values=True))

    def body(self):
        data = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        while "chunked" in self.headers.get("Transfer-Encoding", ""):
            n = int(self.rfile.readline(), 16)
            data += self.rfile.read(n)
            self.rfile.readline()
            if not n:
                break
        if "aws-chunked" in self.headers.get("Content-Encoding", "") or "STREAMING" in self.headers.get("x-amz-content-sha256", ""):
            out = b""
            while data:
                size, _, data = data.partition(b"\r\n")
                n = int(size.split(b";")[0], 16)
                if not n:
                    break
                out, data = out + data[:n], data[n + 2 :]
            return out
        return data

    def etag(self, data):
        return f'"{hashlib.md5(data).hexdigest()}"'

    def do_HEAD(self):  # noqa: N802
        self.do_GET()

    def do_GET(self):  # noqa: N802
        key, q = self.asked()
        objects = self.server.objects
        if "/" not in key.rstrip("/") and ("list-type" in q or self.command == "HEAD"):
            if self.command == "HEAD":
                return self.answer(200)
            return self.listed(key.rstrip("/"), q)
        if key not in objects:
            return self.answer(404, b"" if self.command == "HEAD" else b"<Error><Code>NoSuchKey</Code></Error>")
        data = objects[key]
        self.server.gets += self.command == "GET"
        found = re.match(r"bytes=(\d+)-(\d*)", self.headers.get("Range", ""))
        if found:
            low, high = int(found[1]), min(int(found[2] or len(data)), len(data) - 1)
            part = data[low : high + 1]
            return self.answer(206, part, ETag=self.etag(data), Content_Range=f"bytes {low}-{high}/{len(data)}")
        if self.command == "HEAD":
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.send_header("ETag", self.etag(data))
            return self.end_headers()
        return self.answer(200, data, ETag=self.etag(data))

    def listed(self, bucket, q):
        prefix, ends = q.get("prefix", ""), q.get("delimiter", "")
        keys, folders = [], set()
        for key, data in sorted(self.server.objects.items()):
            if not key.startswith(f"{bucket}/{prefix}"):
                continue
            own = key[len(bucket) + 1 :]
            rest = own[len(prefix) :]
            if ends and ends in rest:
                folders.add(prefix + rest.split(ends)[0] + ends)
            else:
                keys.append(f"<Contents><Key>{own}</Key><Size>{len(data)}</Size><ETag>{self.etag(data)}</ETag><LastModified>2024-01-01T00:00:00.000Z</LastModified></Contents>")
        common = [f"<CommonPrefixes><Prefix>{x}</Prefix></CommonPrefixes>" for x in sorted(folders)]
        body = f"<ListBucketResult><Name>{bucket}</Name><IsTruncated>false</IsTruncated><KeyCount>{len(keys) + len(common)}</KeyCount>{''.join(keys + common)}</ListBucketResult>"
        self.answer(200, body.encode(), Content_Type="application/xml")

    def do_PUT(self):  # noqa: N802
        key, q = self.asked()
        data = self.body()
        if "x-amz-copy-source" in self.headers:
            data = self.server.objects[urllib.parse.unquote(self.headers["x-amz-copy-source"]).lstrip("/")]
            self.server.objects[key] = data
            return self.answer(200, f"<CopyObjectResult><ETag>{self.etag(data)}</ETag></CopyObjectResult>".encode())
        if "partNumber" in q:
            self.server.parts[q["uploadId"]][int(q["partNumber"])] = data
        elif "/" in key.rstrip("/"):
            self.server.objects[key] = data
        return self.answer(200, ETag=self.etag(data))

    def do_POST(self):  # noqa: N802
        key, q = self.asked()
        data = self.body()
        if "uploads" in q:
            with self.server.lock:
                upload = str(len(self.server.parts))
                self.server.parts[upload] = {}
            return self.answer(200, f"<InitiateMultipartUploadResult><Key>{key}</Key><UploadId>{upload}</UploadId></InitiateMultipartUploadResult>".encode())
        if "delete" in q:
            for own in re.findall(r"<Key>(.*?)</Key>", data.decode()):
                self.server.objects.pop(f"{key.rstrip('/')}/{own}", None)
            return self.answer(200, b"<DeleteResult></DeleteResult>")
        parts = self.server.parts[q["uploadId"]]
        self.server.objects[key] = b"".join(parts[k] for k in sorted(parts))
        return self.answer(200, f"<CompleteMultipartUploadResult><Key>{key}</Key><ETag>{self.etag(b'')}</ETag></CompleteMultipartUploadResult>".encode())

    def do_DELETE(self):  # noqa: N802
        key, _ = self.asked()
        self.server.objects.pop(key, None)
        self.answer(204)

    def log_message(self, *args):
        pass


def serve():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    server.objects, server.parts, server.lock, server.gets = {}, {}, threading.Lock(), 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def uri(server, path):
    return f"s3://key:secret@{path}?endpoint_override=127.0.0.1%3A{server.server_port}&scheme=http&region=us-east-1&allow_bucket_creation=true"
