"""A small web project, one of each kind of file."""

FILES = {
    "package.json": """{
  "name": "shop",
  "dependencies": {"next": "14", "react": "18", "express": "4", "mongoose": "8"}
}""",
    ".gitignore": "# tools\n/scripts\n*.gen.ts\nlogs/\n!keep.ts\n",
    "app/api/pay/route.ts": (
        'import Pay from "pay";\nimport { db } from "../../../lib/db.js";\n'
        "export async function POST(req: Request) { return db; }\n"
        "export const GET = () => 1;\n"
    ),
    "app/board/[id]/page.tsx": (
        'import { Card } from "../../../src/components/Card.js";\n'
        "export default function BoardPage() {\n  return <Card cartId='x' />;\n}\n"
    ),
    "src/components/Card.tsx": (
        '"use client";\nimport { useState } from "react";\n'
        "export function Card({ cartId, ...rest }: { cartId: string }) {\n"
        "  const [on, setOn] = useState(false);\n  useEffect(() => {});\n"
        "  return <button>{cartId}</button>;\n}\n"
    ),
    "src/models/Seat.ts": (
        'import mongoose from "mongoose";\n'
        "const SeatSchema = new mongoose.Schema({\n"
        "  token: { type: String, list: [1, 2] },\n  userId: String,\n"
        "  expires: { type: Date, default: Date.now() },\n});\n"
        'export const Seat = mongoose.model("Seat", SeatSchema);\n'
    ),
    "src/server.ts": (
        'import express from "express";\nconst app = express();\nconst router = express.Router();\n'
        'app.get("/health", h);\nrouter.post("/orders", h);\napp.use("/api", router);\n'
        '// app.get("/hidden", h);\n'
    ),
    "db/001.sql": (
        "CREATE TABLE IF NOT EXISTS shop.users (\n  id uuid PRIMARY KEY DEFAULT gen(1, 2),\n"
        "  price numeric(10, 2),\n  PRIMARY KEY (id)\n);\ncreate table orders (id int);\n"
    ),
    "prisma/schema.prisma": "model Order {\n  id String @id\n  // note\n  total Float\n  @@index([id])\n}\n",
    "lib/db.ts": "export const db: string[] = [];\n\nexport function connect(): void {}\n",
    "scripts/run.ts": "export const x = 1;\n",
    "a/b.gen.ts": "export const y = 1;\n",
    "src/logs/z.ts": "export const z = 1;\n",
    "node_modules/p/index.js": "module.exports = 1;\n",
    "lib/types.d.ts": "export type T = 1;\n",
    "README.md": "# Shop\n",
}


def rows(repo="shop"):
    return [(repo, path, text) for path, text in FILES.items()]
